"""Registered chart-data queries (G1-G22) over views of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts as G
from ..plans.view import compile_view
from .common import R, Registry, catalog, rounded

reg = Registry()

CAT = "COALESCE(NULLIF(CAST({} AS VARCHAR), ''), '未知')"

LP_VIEW = {"from_tables": ["lineitem"],
           "joins": [{"left_table": "lineitem", "right_table": "part",
                      "left_key": "l_partkey", "right_key": "p_partkey"}],
           "columns": [{"table": "lineitem", "column": c} for c in
                       ("l_orderkey", "l_quantity", "l_extendedprice", "l_discount",
                        "l_returnflag", "l_shipdate")] +
                      [{"table": "part", "column": c} for c in ("p_brand", "p_type")]}
LP_SQL = "lineitem JOIN part ON l_partkey = p_partkey"


def lp(spark, d):
    return compile_view(catalog(spark, d), LP_VIEW)


def top10_sql(base: str, cat_expr: str, n: int = 10) -> str:
    """CTEs 'b' (base + cat) and 'm' (+ cat2 = top-n or 其他)."""
    return f"""b AS (SELECT *, {cat_expr} AS cat FROM {base}),
cnt AS (SELECT cat, COUNT(*) AS n FROM b GROUP BY 1),
rk AS (SELECT cat, ROW_NUMBER() OVER (ORDER BY n DESC, cat) AS r, COUNT(*) OVER () AS k FROM cnt),
m AS (SELECT b.*, CASE WHEN rk.k <= {n} OR rk.r <= {n} THEN b.cat ELSE '其他' END AS cat2
      FROM b JOIN rk ON b.cat = rk.cat)"""


@reg.add("g_category", f"""
SELECT {CAT.format('l_returnflag')} AS category, COUNT(*) AS n
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def g_category(spark, d):
    cfg = {"from_tables": ["orders"],
           "joins": [{"left_table": "orders", "right_table": "lineitem", "join_type": "LEFT",
                      "left_key": "o_orderkey", "right_key": "l_orderkey"}],
           "columns": [{"table": "orders", "column": "o_orderkey"},
                       {"table": "lineitem", "column": "l_returnflag"}]}
    df = compile_view(catalog(spark, d), cfg)
    return df.groupBy(G.category(F.col("l_returnflag")).alias("category")).agg(
        F.count(F.lit(1)).alias("n"))


@reg.add("g_top_other", f"""
WITH {top10_sql('part', CAT.format('p_brand'))}
SELECT cat2 AS p_brand, COUNT(*) AS n FROM m GROUP BY 1""")
def g_top_other(spark, d):
    df, _cats = G.limit_categories(catalog(spark, d).table("part"), "p_brand")
    return df.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@reg.add("g_aggregate", f"""
SELECT p_type, {CAT.format('l_returnflag')} AS l_returnflag,
       {R('AVG(l_quantity)')} AS l_quantity, {R('AVG(l_extendedprice)')} AS l_extendedprice
FROM {LP_SQL} GROUP BY 1, 2""")
def g_aggregate(spark, d):
    return rounded(G.aggregate_categories(lp(spark, d), "p_type",
                                          ["l_quantity", "l_extendedprice"], "l_returnflag", "AVG"))


@reg.add("g_aggregate_count", f"""
SELECT p_type, COUNT(*) AS l_quantity FROM {LP_SQL} GROUP BY 1""")
def g_aggregate_count(spark, d):
    return G.aggregate_categories(lp(spark, d), "p_type", ["l_quantity"], None, "COUNT")


_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@reg.add("g_bar", "SELECT p_brand, " + ", ".join(
    f"{R(f'SUM(l_quantity) FILTER (WHERE p_type = {chr(39)}{t}{chr(39)})')} AS \"l_quantity||{t}\""
    for t in _TYPES) + f" FROM {LP_SQL} GROUP BY 1")
def g_bar(spark, d):
    return rounded(G.bar(lp(spark, d), "p_brand", ["l_quantity"], cat="p_type", method="SUM"))


@reg.add("g_bar_other", f"""
WITH {top10_sql(LP_SQL, CAT.format('p_brand'))}
SELECT p_type, cat2 AS p_brand, {R('SUM(l_extendedprice)')} AS l_extendedprice FROM m GROUP BY 1, 2""")
def g_bar_other(spark, d):
    df, _ = G.limit_categories(lp(spark, d), "p_brand")
    return rounded(G.aggregate_categories(df, "p_type", ["l_extendedprice"], "p_brand", "SUM"))


@reg.add("g_line", "SELECT strftime(o_orderdate, '%Y-%m') AS o_orderdate, " + ", ".join(
    f"{R(f'SUM(o_totalprice) FILTER (WHERE o_orderstatus = {chr(39)}{s}{chr(39)})')} "
    f"AS \"o_totalprice||{s}\"" for s in "FOP") + """
FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'
GROUP BY 1""")
def g_line(spark, d):
    df = catalog(spark, d).table("orders")
    return rounded(G.line(df, "o_orderdate", ["o_totalprice"], cat="o_orderstatus",
                          granularity="month", start="1996-01-01", end="1998-12-31"))


@reg.add("g_series_week", f"""
SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS ts, NULLIF(event_type, '') AS event_type,
       {R('AVG(value)')} AS value FROM events GROUP BY 1, 2""")
def g_series_week(spark, d):
    df = catalog(spark, d).table("events")
    return rounded(G.bucket_series(df, "ts", ["value"], "week", "AVG", "event_type"))


@reg.add("g_series_quarter", """
SELECT strftime(o_orderdate, '%Y') || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS o_orderdate,
       o_orderpriority, COUNT(*) AS o_totalprice FROM orders GROUP BY 1, 2""")
def g_series_quarter(spark, d):
    df = catalog(spark, d).table("orders")
    return G.bucket_series(df, "o_orderdate", ["o_totalprice"], "quarter", "COUNT",
                           "o_orderpriority")


@reg.add("g_series_year", f"""
SELECT strftime(l_shipdate, '%Y') AS l_shipdate, {R('MAX(l_extendedprice)')} AS l_extendedprice,
       {R('MIN(l_discount)')} AS l_discount FROM lineitem GROUP BY 1""")
def g_series_year(spark, d):
    df = catalog(spark, d).table("lineitem")
    out = G.bucket_series(df, "l_shipdate", ["l_extendedprice"], "year", "MAX")
    mins = G.bucket_series(df, "l_shipdate", ["l_discount"], "year", "MIN")
    return rounded(out.join(mins, "l_shipdate"))


@reg.add("g_line_days", f"""
SELECT strftime(ts, '%Y-%m-%d') AS ts, {R('SUM(value)')} AS value FROM events
WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22' GROUP BY 1""")
def g_line_days(spark, d):
    df = catalog(spark, d).table("events").select("ts", "value")
    return rounded(G.line(df, "ts", ["value"], granularity="day", start="2024-01-08",
                          end="2024-01-21"))


@reg.add("g_raw_series", """
SELECT ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07'""")
def g_raw_series(spark, d):
    df = catalog(spark, d).table("events").select("ts", "value")
    return G.line(df, "ts", ["value"], granularity="none", start="2024-01-05", end="2024-01-06")


_HIST = f"""
WITH v AS (SELECT 'l_quantity' AS col, CAST(l_quantity AS DOUBLE) AS v FROM lineitem
           WHERE l_quantity IS NOT NULL
           UNION ALL SELECT 'l_extendedprice', CAST(l_extendedprice AS DOUBLE) FROM lineitem
           WHERE l_extendedprice IS NOT NULL),
b AS (SELECT MIN(v) AS lo, MAX(v) AS hi FROM v),
w AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo,
             (CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END - CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END)
             / CAST(20 AS DOUBLE) AS width FROM b),
c AS (SELECT LEAST(CAST(FLOOR((v - lo) / width) AS BIGINT), 19) AS bin, col FROM v, w)
SELECT g.bin AS bin, {R('w.lo + CAST(g.bin AS DOUBLE) * w.width', 4)} AS bin_start,
       {R('w.lo + CAST(g.bin + 1 AS DOUBLE) * w.width', 4)} AS bin_end,
       COUNT(c.col) FILTER (WHERE c.col = 'l_quantity') AS l_quantity,
       COUNT(c.col) FILTER (WHERE c.col = 'l_extendedprice') AS l_extendedprice
FROM (SELECT CAST(range AS BIGINT) AS bin FROM range(20)) g JOIN w ON TRUE
LEFT JOIN c ON c.bin = g.bin GROUP BY g.bin, w.lo, w.width"""


@reg.add("g_hist", _HIST)
def g_hist(spark, d):
    df = catalog(spark, d).table("lineitem")
    return rounded(G.histogram(df, ["l_quantity", "l_extendedprice"], 20), 4)


def _box_sql(base: str, cat_expr: str | None, top: bool = True) -> str:
    if cat_expr:
        pre = f"""{top10_sql(base, cat_expr)},
keep AS (SELECT cat FROM cnt ORDER BY n DESC, cat LIMIT 10),
v AS (SELECT cat AS category, CAST(value AS DOUBLE) AS value FROM b
      WHERE cat IN (SELECT cat FROM keep) AND value IS NOT NULL)"""
    else:
        pre = f"""v AS (SELECT '全部' AS category, CAST(value AS DOUBLE) AS value FROM {base}
      WHERE value IS NOT NULL)"""
    return f"""WITH {pre},
s AS (SELECT category, COUNT(*) AS count, quantile_cont(value, 0.25) AS q1,
             quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
      FROM v GROUP BY 1),
f AS (SELECT v.category, v.value, (v.value < s.q1 - 1.5 * (s.q3 - s.q1)
             OR v.value > s.q3 + 1.5 * (s.q3 - s.q1)) AS out FROM v JOIN s USING (category))"""


_LP_VALUE = f"(SELECT l_extendedprice AS value, p_brand, l_returnflag FROM {LP_SQL})"


@reg.add("g_box", _box_sql(_LP_VALUE, CAT.format("p_brand")) + f"""
SELECT s.category, s.count, {R('s.q1', 4)} AS q1, {R('s.median', 4)} AS median, {R('s.q3', 4)} AS q3,
       {R('COALESCE(MIN(f.value) FILTER (WHERE NOT f.out), s.q1)', 4)} AS whisker_low,
       {R('COALESCE(MAX(f.value) FILTER (WHERE NOT f.out), s.q3)', 4)} AS whisker_high
FROM s LEFT JOIN f USING (category) GROUP BY s.category, s.count, s.q1, s.median, s.q3""")
def g_box(spark, d):
    return rounded(G.boxplot(lp(spark, d), "l_extendedprice", "p_brand"), 4)


@reg.add("g_box_all", _box_sql("(SELECT o_totalprice AS value FROM orders)", None) + f"""
SELECT s.category, s.count, {R('s.q1', 4)} AS q1, {R('s.median', 4)} AS median, {R('s.q3', 4)} AS q3,
       {R('COALESCE(MIN(f.value) FILTER (WHERE NOT f.out), s.q1)', 4)} AS whisker_low,
       {R('COALESCE(MAX(f.value) FILTER (WHERE NOT f.out), s.q3)', 4)} AS whisker_high
FROM s LEFT JOIN f USING (category) GROUP BY s.category, s.count, s.q1, s.median, s.q3""")
def g_box_all(spark, d):
    return rounded(G.boxplot(catalog(spark, d).table("orders"), "o_totalprice"), 4)


@reg.add("g_outliers", _box_sql("(SELECT value, event_type FROM events)",
                                 CAT.format("event_type")) + f"""
SELECT category, {R('value')} AS value FROM f WHERE out""")
def g_outliers(spark, d):
    return rounded(G.boxplot_outliers(catalog(spark, d).table("events"), "value", "event_type"))


NATION_VIEW = {"from_tables": ["lineitem"],
               "joins": [{"left_table": "lineitem", "right_table": "orders",
                          "left_key": "l_orderkey", "right_key": "o_orderkey"},
                         {"left_table": "orders", "right_table": "customer",
                          "left_key": "o_custkey", "right_key": "c_custkey"},
                         {"left_table": "customer", "right_table": "nation",
                          "left_key": "c_nationkey", "right_key": "n_nationkey"}],
               "columns": [{"table": "nation", "column": "n_name"},
                           {"table": "lineitem", "column": "l_extendedprice"},
                           {"table": "orders", "column": "o_orderpriority"},
                           {"table": "orders", "column": "o_totalprice"}]}
NATION_SQL = """lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey"""
_PIE_CTE = f"""s AS (SELECT COALESCE(CAST(n_name AS VARCHAR), '未知') AS name,
             SUM(COALESCE(TRY_CAST(l_extendedprice AS DOUBLE), 0)) AS value FROM {NATION_SQL} GROUP BY 1),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY value DESC, name) AS rk, COUNT(*) OVER () AS k FROM s),
p AS (SELECT CASE WHEN k <= 8 OR rk <= 8 THEN name ELSE '其他' END AS name, SUM(value) AS value
      FROM r GROUP BY 1)"""


@reg.add("g_pie", f"WITH {_PIE_CTE} SELECT name, {R('value')} AS value FROM p")
def g_pie(spark, d):
    df = compile_view(catalog(spark, d), NATION_VIEW)
    return rounded(G.pie(df, "n_name", "l_extendedprice", "SUM"))


@reg.add("g_pie_avg", f"""
SELECT COALESCE(CAST(o_orderpriority AS VARCHAR), '未知') AS name, {R('AVG(o_totalprice)')} AS value
FROM orders GROUP BY 1""")
def g_pie_avg(spark, d):
    return rounded(G.pie(catalog(spark, d).table("orders"), "o_orderpriority", "o_totalprice", "AVG"))


@reg.add("g_pie_share", f"""WITH {_PIE_CTE}
SELECT name, {R('value')} AS value, {R('value / SUM(value) OVER () * 100', 1)} AS share
FROM p WHERE name != '其他'""")
def g_pie_share(spark, d):
    df = compile_view(catalog(spark, d), NATION_VIEW)
    slices = G.pie(df, "n_name", "l_extendedprice", "SUM")
    return rounded(G.pie_share(slices, hidden=("其他",)))


@reg.add("g_kpi_tile", f"""
SELECT {R('AVG(o_totalprice)')} AS value FROM orders""")
def g_kpi_tile(spark, d):
    return rounded(G.kpi_tile(catalog(spark, d).table("orders"), "o_totalprice", "AVG"))


@reg.add("g_kpi_tile_text", "SELECT SUM(TRY_CAST(props AS DOUBLE)) AS value FROM events")
def g_kpi_tile_text(spark, d):
    return G.kpi_tile(catalog(spark, d).table("events"), "props", "SUM")


@reg.add("g_kpi_tile_count", "SELECT CAST(COUNT(*) AS DOUBLE) AS value FROM events")
def g_kpi_tile_count(spark, d):
    return G.kpi_tile(catalog(spark, d).table("events"), "props", "COUNT")


@reg.add("g_kpi", f"""
SELECT {R('MIN(l_discount)', 4)} AS value FROM lineitem""")
def g_kpi(spark, d):
    return rounded(G.kpi(catalog(spark, d).table("lineitem"), "l_discount", "MIN"), 4)


@reg.add("g_kpi_count_text", """
SELECT CAST(COUNT(*) FILTER (WHERE TRY_CAST(trim(event_type) AS DOUBLE) IS NOT NULL
       OR trim(event_type) = '' OR event_type IS NULL) AS DOUBLE) AS value FROM events""")
def g_kpi_count_text(spark, d):
    return G.kpi(catalog(spark, d).table("events"), "event_type", "COUNT")


def _kpi_change_sql(table, col, date_col, fmt, prev, ya):
    return f"""
WITH p AS (SELECT strftime({date_col}, '{fmt}') AS period, SUM(COALESCE({col}, 0)) AS value
           FROM {table} WHERE {date_col} IS NOT NULL GROUP BY 1),
c AS (SELECT MAX(period) AS period FROM p)
SELECT c.period, {R('cur.value')} AS value,
  {R('CASE WHEN pv.value <> 0 THEN (cur.value - pv.value) / pv.value * 100 END', 4)} AS prev_change,
  {R('CASE WHEN ya.value <> 0 THEN (cur.value - ya.value) / ya.value * 100 END', 4)} AS year_ago_change
FROM c JOIN p cur ON cur.period = c.period
LEFT JOIN p pv ON pv.period = {prev}
LEFT JOIN p ya ON ya.period = {ya}"""


@reg.add("g_kpi_change", _kpi_change_sql(
    "orders", "o_totalprice", "o_orderdate", "%Y-%m",
    "strftime(CAST(c.period || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m')",
    "strftime(CAST(c.period || '-01' AS DATE) - INTERVAL 12 MONTH, '%Y-%m')"))
def g_kpi_change(spark, d):
    df = catalog(spark, d).table("orders")
    return rounded(G.kpi_change(df, "o_totalprice", "SUM", "o_orderdate", "month"), 4)


@reg.add("g_kpi_change_day", _kpi_change_sql(
    "events", "value", "ts", "%Y-%m-%d",
    "strftime(CAST(c.period AS DATE) - INTERVAL 1 DAY, '%Y-%m-%d')",
    "strftime(CAST(c.period AS DATE) - INTERVAL 1 YEAR, '%Y-%m-%d')"))
def g_kpi_change_day(spark, d):
    df = catalog(spark, d).table("events")
    return rounded(G.kpi_change(df, "value", "SUM", "ts", "day"), 4)


@reg.add("g_kpi_change_year", _kpi_change_sql(
    "lineitem", "l_extendedprice", "l_shipdate", "%Y",
    "CAST(CAST(c.period AS INTEGER) - 1 AS VARCHAR)", "CAST(CAST(c.period AS INTEGER) - 1 AS VARCHAR)"))
def g_kpi_change_year(spark, d):
    df = catalog(spark, d).table("lineitem")
    return rounded(G.kpi_change(df, "l_extendedprice", "SUM", "l_shipdate", "year"), 4)


_SCATTER = f"""
WITH base AS (SELECT {CAT.format('l_returnflag')} AS category, CAST(l_quantity AS DOUBLE) AS x,
                     l_extendedprice, l_discount FROM lineitem WHERE l_quantity IS NOT NULL),
pts AS (SELECT 'l_extendedprice' AS series, category, x, CAST(l_extendedprice AS DOUBLE) AS y
        FROM base WHERE l_extendedprice IS NOT NULL
        UNION ALL SELECT 'l_discount', category, x, CAST(l_discount AS DOUBLE) FROM base
        WHERE l_discount IS NOT NULL),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series, category ORDER BY x, y) - 1 AS pos,
             COUNT(*) OVER (PARTITION BY series, category) AS n FROM pts),
s AS (SELECT *, CAST(n AS DOUBLE) / CAST(2000 AS DOUBLE) AS stride FROM r),
t AS (SELECT *, FLOOR(CAST(pos AS DOUBLE) / stride) AS i1 FROM s)
SELECT series, category, {R('x')} AS x, {R('y', 4)} AS y FROM t
WHERE n <= 2000
   OR (i1 - 1 < 2000 AND FLOOR((i1 - 1) * stride) = pos)
   OR (i1 < 2000 AND FLOOR(i1 * stride) = pos)
   OR (i1 + 1 < 2000 AND FLOOR((i1 + 1) * stride) = pos)"""


@reg.add("g_scatter", _SCATTER)
def g_scatter(spark, d):
    df = catalog(spark, d).table("lineitem")
    out = G.scatter_sampled(df, "l_quantity", ["l_extendedprice", "l_discount"], "l_returnflag")
    return out.select("series", "category", F.round(F.col("x").cast("decimal(38,6)"), 2)
                      .cast("double").alias("x"),
                      F.round(F.col("y").cast("decimal(38,6)"), 4).cast("double").alias("y"))


@reg.add("g_scatter_points", f"""
SELECT 'o_totalprice' AS series, '' AS category, {R('CAST(o_custkey AS DOUBLE)')} AS x,
       {R('o_totalprice')} AS y FROM orders""")
def g_scatter_points(spark, d):
    return rounded(G.scatter(catalog(spark, d).table("orders"), "o_custkey", ["o_totalprice"]))


@reg.add("g_table", f"""
SELECT o_orderkey, o_orderdate, {R('o_totalprice')} AS o_totalprice FROM orders
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey, o_orderdate, o_totalprice LIMIT 20 OFFSET 40""")
def g_table(spark, d):
    df = catalog(spark, d).table("orders")
    return rounded(G.table_chart(df, ["o_orderkey", "o_orderdate", "o_totalprice"],
                                 "o_totalprice", "desc", page=3))


@reg.add("g_table_deep", f"""
SELECT o_orderkey, {R('o_totalprice')} AS o_totalprice FROM orders
ORDER BY o_totalprice ASC NULLS LAST, o_orderkey, o_totalprice LIMIT 20 OFFSET 12000""")
def g_table_deep(spark, d):
    return rounded(G.table_chart(catalog(spark, d).table("orders"), ["o_orderkey", "o_totalprice"], "o_totalprice", page=601))


@reg.add("g_kinds", """
SELECT 'key_text' AS "column", CASE WHEN bool_and(TRY_CAST(trim(CAST(o_orderkey AS VARCHAR)) AS DOUBLE) IS NOT NULL)
  THEN 'number' WHEN bool_and(regexp_matches(CAST(o_orderkey AS VARCHAR), '^\\d{4}-\\d{2}-\\d{2}')) THEN 'date'
  ELSE 'text' END AS kind FROM orders
UNION ALL SELECT 'day_text', CASE WHEN bool_and(TRY_CAST(trim(strftime(o_orderdate, '%Y-%m-%d')) AS DOUBLE) IS NOT NULL)
  THEN 'number' WHEN bool_and(regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '^\\d{4}-\\d{2}-\\d{2}')) THEN 'date'
  ELSE 'text' END FROM orders
UNION ALL SELECT 'o_orderstatus', CASE WHEN bool_and(TRY_CAST(trim(o_orderstatus) AS DOUBLE) IS NOT NULL)
  THEN 'number' WHEN bool_and(regexp_matches(o_orderstatus, '^\\d{4}-\\d{2}-\\d{2}')) THEN 'date'
  ELSE 'text' END FROM orders
UNION ALL SELECT 'o_totalprice', 'number'
UNION ALL SELECT 'o_orderdate', 'date'""")
def g_kinds(spark, d):
    df = catalog(spark, d).table("orders").select(
        F.col("o_orderkey").cast("string").alias("key_text"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"),
        "o_orderstatus", "o_totalprice", "o_orderdate")
    return G.column_kinds(df)


@reg.add("g_numeric_text", """
WITH t AS (SELECT l_orderkey % 7 AS g, CASE l_linenumber % 4 WHEN 0 THEN l_quantity::BIGINT || 'F' WHEN 1 THEN l_quantity::BIGINT || 'd'
                  WHEN 2 THEN l_quantity::BIGINT || 'e1' ELSE ' ' || l_quantity::BIGINT END AS v FROM lineitem)
SELECT CAST(g AS VARCHAR) AS g, SUM(CASE WHEN v LIKE '%F' OR v LIKE '%d' THEN NULL ELSE CAST(trim(v) AS DOUBLE) END) AS v
FROM t GROUP BY 1""")
def g_numeric_text(spark, d):
    """Text cells with a letter behind the digits are not numbers; 1e1 is."""
    n = F.col("l_quantity").cast("long").cast("string")
    li = catalog(spark, d).table("lineitem").select(
        (F.col("l_orderkey") % 7).alias("g"),
        F.when(F.col("l_linenumber") % 4 == 0, F.concat(n, F.lit("F")))
         .when(F.col("l_linenumber") % 4 == 1, F.concat(n, F.lit("d")))
         .when(F.col("l_linenumber") % 4 == 2, F.concat(n, F.lit("e1"))).otherwise(F.concat(F.lit(" "), n)).alias("v"))
    return G.aggregate_categories(li, "g", ["v"], None, "SUM")


@reg.add("g_box_ties", """
WITH q AS (SELECT l_returnflag AS category, COUNT(*) AS count, quantile_cont(l_discount, 0.25) AS q1,
                  quantile_cont(l_discount, 0.5) AS median, quantile_cont(l_discount, 0.75) AS q3 FROM lineitem GROUP BY 1)
SELECT category, count, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3 FROM q""")
def g_box_ties(spark, d):
    """Quartiles over a column of eleven values."""
    box = G.boxplot(catalog(spark, d).table("lineitem"), "l_discount", "l_returnflag")
    return box.select("category", "count", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")])
