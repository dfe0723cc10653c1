"""Registered time-profile queries (T1-T6) over a view of ``events``."""

from __future__ import annotations

import datetime as dt

from ..operators.timeprofile import preset_filter, rebucket, time_filter
from ..plans.view import compile_view
from .common import R, Registry, catalog, rounded

reg = Registry()

EVENTS_VIEW = {"from_tables": ["events"],
               "columns": [{"table": "events", "column": c}
                           for c in ("ts", "user_id", "event_type", "value", "props")]}


def events_view(spark, d):
    return compile_view(catalog(spark, d), EVENTS_VIEW)


@reg.add("t_filter", f"""
SELECT ts, user_id, event_type, {R('value')} AS value, props FROM events
WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'""")
def t_filter(spark, d):
    return rounded(time_filter(events_view(spark, d), "ts", "2024-01-10", "2024-01-20"))


def _iso(expr):
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S')"


def _rebucket(gran, agg="SUM"):
    def fn(spark, d):
        return rounded(rebucket(events_view(spark, d), "ts", gran, agg))
    key = _iso(f"date_trunc('{gran}', ts)")
    if agg == "COUNT":
        sql = f"""SELECT {key} AS ts, COUNT(user_id) AS user_id, COUNT(event_type) AS event_type,
COUNT(value) AS value, COUNT(props) AS props FROM events GROUP BY 1"""
    else:
        f = agg
        sql = f"""SELECT {key} AS ts, {R(f'{f}(CAST(user_id AS DOUBLE))')} AS user_id,
{R(f'{f}(value)')} AS value FROM events GROUP BY 1"""
    return fn, sql


for _g in ("day", "week", "month", "quarter", "year"):
    reg.items[f"t_rebucket_{_g}"] = _rebucket(_g)
reg.items["t_count"] = _rebucket("week", "COUNT")
reg.items["t_avg"] = _rebucket("day", "AVG")
reg.items["t_min"] = _rebucket("week", "MIN")
reg.items["t_max"] = _rebucket("month", "MAX")


@reg.add("t_rebucket_text", f"""
SELECT {_iso("date_trunc('week', o_orderdate)")} AS day_text,
       {R('SUM(o_totalprice)')} AS o_totalprice, {R('SUM(TRY_CAST(o_orderstatus AS DOUBLE))')} AS o_orderstatus
FROM orders GROUP BY 1 HAVING TRUE""")
def t_rebucket_text(spark, d):
    # date column given as ISO text: still bucketed; o_orderstatus has no
    # numeric value and is omitted
    from pyspark.sql import functions as F
    df = catalog(spark, d).table("orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"), "o_totalprice")
    return rounded(rebucket(df, "day_text", "week", "SUM"))


reg.items["t_rebucket_text"] = (t_rebucket_text, f"""
SELECT {_iso("date_trunc('week', o_orderdate)")} AS day_text,
       {R('SUM(o_totalprice)')} AS o_totalprice
FROM orders GROUP BY 1""")


@reg.add("t_drop_text_columns", f"""
SELECT {_iso("date_trunc('month', o_orderdate)")} AS o_orderdate, {R('MAX(o_totalprice)')} AS o_totalprice
FROM orders GROUP BY 1""")
def t_drop_text_columns(spark, d):
    # o_orderstatus / o_orderpriority hold no numbers: T4 drops them
    df = catalog(spark, d).table("orders").select(
        "o_orderdate", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return rounded(rebucket(df, "o_orderdate", "month", "MAX"))


@reg.add("t_preset", """
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '1999-10-10' AND o_orderdate < TIMESTAMP '2000-01-11'""")
def t_preset(spark, d):
    df = catalog(spark, d).table("orders").select("o_orderkey", "o_orderdate")
    return preset_filter(df, "o_orderdate", "last3months", dt.date(2000, 1, 10))
