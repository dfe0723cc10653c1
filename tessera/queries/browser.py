"""Registered table-browser queries."""

from __future__ import annotations

from ..plans.browser import browse, browse_total
from .common import R, Registry, catalog, rounded

reg = Registry()

BROWSE = dict(datetime_col="o_orderdate", start="1997-03-01", end="1997-08-31",
              filters=[("o_orderpriority", "URGENT", "contains"),
                       ("o_orderstatus", "O", "exact"),
                       ("no_such_column", "x", "exact"),       # ignored
                       ("o_custkey", "   ", "exact")])         # blank: ignored

_WHERE = """WHERE CAST(o_orderdate AS DATE) >= DATE '1997-03-01'
  AND CAST(o_orderdate AS DATE) <= DATE '1997-08-31'
  AND o_orderpriority LIKE '%URGENT%' AND o_orderstatus = 'O'"""


@reg.add("b_browse", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, {R('o_totalprice')} AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_orderpriority
FROM orders {_WHERE}
ORDER BY orders.o_totalprice DESC NULLS FIRST, o_orderkey, o_custkey, o_orderstatus,
         orders.o_totalprice, orders.o_orderdate, o_orderpriority
LIMIT 25 OFFSET 25""")
def b_browse(spark, d):
    df = catalog(spark, d).table("orders")
    return rounded(browse(df, page=2, size=25, sort_col="o_totalprice", sort_dir="desc", **BROWSE))


@reg.add("b_total", f"SELECT COUNT(*) AS total FROM orders {_WHERE}")
def b_total(spark, d):
    return browse_total(catalog(spark, d).table("orders"), **BROWSE)


@reg.add("b_browse_events", """
SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
       ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts, user_id, event_type,
       CAST(value AS DOUBLE) AS value, props
FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-03' AND CAST(event_id AS VARCHAR) LIKE '%7%'
ORDER BY events.ts ASC NULLS LAST, event_id, events.ts, user_id, event_type, value, props
LIMIT 40""")
def b_browse_events(spark, d):
    df = catalog(spark, d).table("events")
    return browse(df, page=1, size=40, sort_col="ts", sort_dir="asc", datetime_col="ts",
                  end="2024-01-03", filters=[("event_id", "7", "contains")])


@reg.add("b_browse_deep", f"""
SELECT l_orderkey, l_linenumber, {R('l_quantity')} AS l_quantity, l_returnflag FROM lineitem
ORDER BY lineitem.l_returnflag DESC NULLS FIRST, l_orderkey, l_linenumber, lineitem.l_quantity LIMIT 5 OFFSET 49995""")
def b_browse_deep(spark, d):
    # page 10,000 of 5, behind a sort key of three values
    df = catalog(spark, d).table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return rounded(browse(df, page=10_000, size=5, sort_col="l_returnflag", sort_dir="desc"))
