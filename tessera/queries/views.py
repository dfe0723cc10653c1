"""Registered view queries (V1-V30) over the driver tables, with oracles."""

from __future__ import annotations

from ..plans.view import compile_view, preview, view_page, view_total
from .common import R, Registry, catalog, rounded

reg = Registry()


def col(table, column):
    return {"type": "column", "table": table, "column": column}


def const(v):
    return {"type": "constant", "value": str(v)}


# --- flagship: lineitem ⋈ orders, ship-date range, month bucket, group, sum/count
FLAGSHIP = {
    "from_tables": ["lineitem"],
    "joins": [{"left_table": "lineitem", "right_table": "orders", "join_type": "INNER",
               "left_key": "l_orderkey", "right_key": "o_orderkey"}],
    "computed_columns": [{"alias": "ship_month", "expression_type": "datetime_trunc",
                          "trunc_column": col("lineitem", "l_shipdate"), "trunc_unit": "month"}],
    "filters": [{"column": "lineitem.l_shipdate", "date_start": "1996-01-01",
                 "date_end": "1998-12-31"}],
    "group_by": ["o_orderstatus", "ship_month"],
    "aggregations": [{"function": "SUM", "column": "l_extendedprice", "alias": "revenue"},
                     {"function": "COUNT", "column": "*", "alias": "n_lines"}],
    "order_by": [{"column": "ship_month", "direction": "asc"},
                 {"column": "revenue", "direction": "desc"}],
    "limit": 1000,
}


@reg.add("v_flagship", f"""
SELECT o_orderstatus, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS ship_month,
       {R('SUM(l_extendedprice)')} AS revenue, COUNT(*) AS n_lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'
GROUP BY 1, 2""")
def v_flagship(spark, d):
    return rounded(compile_view(catalog(spark, d), FLAGSHIP))


@reg.add("v_projection", f"""
SELECT o_orderkey, {R('o_totalprice')} AS price, o_orderstatus FROM orders""")
def v_projection(spark, d):
    cfg = {"from_tables": ["orders"],
           "columns": [{"table": "orders", "column": "o_orderkey"},
                       {"table": "orders", "column": "o_totalprice", "alias": "price"},
                       {"table": None, "column": "o_orderstatus"},
                       {"table": "orders", "column": "o_orderkey"}]}   # repeat dropped
    return rounded(compile_view(catalog(spark, d), cfg))


@reg.add("v_select_all", """
SELECT a.n_nationkey, a.n_name, a.n_regionkey,
       b.n_nationkey AS nation_1_n_nationkey, b.n_name AS nation_1_n_name,
       b.n_regionkey AS nation_1_n_regionkey
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey""")
def v_select_all(spark, d):
    cfg = {"from_tables": ["nation"],
           "joins": [{"left_table": "nation", "right_table": "nation", "right_alias": "nation_1",
                      "left_key": "n_regionkey", "right_key": "n_regionkey"}]}
    return compile_view(catalog(spark, d), cfg)


@reg.add("v_join_inner", f"""
SELECT o_orderkey, c_name, c_mktsegment, {R('o_totalprice')} AS o_totalprice
FROM orders JOIN customer ON o_custkey = c_custkey""")
def v_join_inner(spark, d):
    cfg = {"from_tables": ["orders"],
           "joins": [{"left_table": "orders", "right_table": "customer",
                      "left_key": "o_custkey", "right_key": "c_custkey"}],
           "columns": [{"table": "orders", "column": "o_orderkey"},
                       {"table": "customer", "column": "c_name"},
                       {"table": "customer", "column": "c_mktsegment"},
                       {"table": "orders", "column": "o_totalprice"}]}
    return rounded(compile_view(catalog(spark, d), cfg))


@reg.add("v_join_left", """
SELECT o_orderkey, o_orderstatus, COUNT(l_orderkey) AS n_lines, COUNT(*) AS n_rows
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def v_join_left(spark, d):
    cfg = {"from_tables": ["orders"],
           "joins": [{"left_table": "orders", "right_table": "lineitem", "join_type": "LEFT",
                      "left_key": "o_orderkey", "right_key": "l_orderkey"}],
           "group_by": ["o_orderkey", "o_orderstatus"],
           "aggregations": [{"function": "COUNT", "column": "l_orderkey", "alias": "n_lines"},
                            {"function": "COUNT", "column": "*", "alias": "n_rows"}]}
    return compile_view(catalog(spark, d), cfg)


@reg.add("v_join_right", f"""
SELECT o_orderkey, l_linenumber, {R('l_quantity')} AS l_quantity
FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey""")
def v_join_right(spark, d):
    cfg = {"from_tables": ["lineitem"],
           "joins": [{"left_table": "lineitem", "right_table": "orders", "join_type": "RIGHT",
                      "left_key": "l_orderkey", "right_key": "o_orderkey"}],
           "columns": [{"table": "orders", "column": "o_orderkey"},
                       {"table": "lineitem", "column": "l_linenumber"},
                       {"table": "lineitem", "column": "l_quantity"}]}
    return rounded(compile_view(catalog(spark, d), cfg))


@reg.add("v_self_join", """
SELECT a.n_name AS nation, b.n_name AS peer FROM nation a
JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE b.n_name != a.n_name""")
def v_self_join(spark, d):
    from pyspark.sql import functions as F
    cfg = {"from_tables": ["nation"],
           "joins": [{"left_table": "nation", "right_table": "nation", "right_alias": "nation_1",
                      "left_key": "n_regionkey", "right_key": "n_regionkey"}],
           "columns": [{"table": "nation", "column": "n_name", "alias": "nation"},
                       {"table": "nation_1", "column": "n_name", "alias": "peer"}]}
    return compile_view(catalog(spark, d), cfg).filter(F.col("nation") != F.col("peer"))


@reg.add("v_chain", f"""
SELECT n_name, r_name, {R('SUM(l_extendedprice)')} AS revenue, COUNT(*) AS n_lines,
       COUNT(o_orderkey) AS n_matched
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def v_chain(spark, d):
    cfg = {"from_tables": ["lineitem"],
           "joins": [{"left_table": "lineitem", "right_table": "orders",
                      "left_key": "l_orderkey", "right_key": "o_orderkey"},
                     {"left_table": "orders", "right_table": "customer",
                      "left_key": "o_custkey", "right_key": "c_custkey"},
                     {"left_table": "customer", "right_table": "nation",
                      "left_key": "c_nationkey", "right_key": "n_nationkey"},
                     {"left_table": "nation", "right_table": "region", "join_type": "LEFT",
                      "left_key": "n_regionkey", "right_key": "r_regionkey"}],
           "group_by": ["n_name", "r_name"],
           "aggregations": [{"function": "SUM", "column": "l_extendedprice", "alias": "revenue"},
                            {"function": "COUNT", "column": "*", "alias": "n_lines"},
                            {"function": "COUNT", "column": "o_orderkey", "alias": "n_matched"}]}
    return rounded(compile_view(catalog(spark, d), cfg))


@reg.add("v_filters_cmp", f"""
SELECT o_orderkey, o_orderpriority, {R('o_totalprice')} AS o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_totalprice < 300000
  AND o_orderpriority != '5-LOW' AND o_custkey > 10 AND o_custkey <= 1400""")
def v_filters_cmp(spark, d):
    cfg = {"from_tables": ["orders"],
           "columns": [{"table": "orders", "column": c}
                       for c in ("o_orderkey", "o_orderpriority", "o_totalprice")],
           "filters": [{"column": "orders.o_orderstatus", "operator": "eq", "value": "F"},
                       {"column": "o_totalprice", "operator": "gte", "value": 100000},
                       {"column": "o_totalprice", "operator": "lt", "value": "300000"},
                       {"column": "o_orderpriority", "operator": "neq", "value": "5-LOW"},
                       {"column": "o_custkey", "operator": "gt", "value": 10},
                       {"column": "o_custkey", "operator": "lte", "value": 1400}]}
    return rounded(compile_view(catalog(spark, d), cfg))


@reg.add("v_filters_text", """
SELECT p_partkey, p_name, p_brand, p_type FROM part
WHERE p_name LIKE '%gear%' AND p_brand LIKE 'Brand#1%' AND p_type LIKE '%L'""")
def v_filters_text(spark, d):
    cfg = {"from_tables": ["part"],
           "columns": [{"table": "part", "column": c}
                       for c in ("p_partkey", "p_name", "p_brand", "p_type")],
           "filters": [{"column": "p_name", "operator": "contains", "value": "gear"},
                       {"column": "p_brand", "operator": "startswith", "value": "Brand#1"},
                       {"column": "p_type", "operator": "endswith", "value": "L"}]}
    return compile_view(catalog(spark, d), cfg)


@reg.add("v_filters_wildcard", """
SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#_5%'""")
def v_filters_wildcard(spark, d):
    # '_' in the value is a LIKE wildcard, as in the original
    cfg = {"from_tables": ["part"],
           "columns": [{"table": "part", "column": "p_partkey"},
                       {"table": "part", "column": "p_brand"}],
           "filters": [{"column": "p_brand", "operator": "startswith", "value": "Brand#_5"}]}
    return compile_view(catalog(spark, d), cfg)


@reg.add("v_filters_null", """
SELECT o_orderkey, o_orderstatus FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_orderkey IS NULL AND o_orderstatus IS NOT NULL""")
def v_filters_null(spark, d):
    cfg = {"from_tables": ["orders"],
           "joins": [{"left_table": "orders", "right_table": "lineitem", "join_type": "LEFT",
                      "left_key": "o_orderkey", "right_key": "l_orderkey"}],
           "columns": [{"table": "orders", "column": "o_orderkey"},
                       {"table": "orders", "column": "o_orderstatus"}],
           "filters": [{"column": "lineitem.l_orderkey", "operator": "is_null"},
                       {"column": "o_orderstatus", "operator": "is_not_null"}]}
    return compile_view(catalog(spark, d), cfg)


@reg.add("v_date_range", """
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1996-03-01'""")
def v_date_range(spark, d):
    cfg = {"from_tables": ["orders"],
           "columns": [{"table": "orders", "column": "o_orderkey"},
                       {"table": "orders", "column": "o_orderdate"}],
           "filters": [{"column": "o_orderdate", "date_start": "1996-02-01",
                        "date_end": "1996-02-29", "operator": "eq", "value": "ignored"}]}
    return compile_view(catalog(spark, d), cfg)


@reg.add("v_date_open_end", """
SELECT COUNT(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-15'""")
def v_date_open_end(spark, d):
    cfg = {"from_tables": ["orders"],
           "filters": [{"column": "o_orderdate", "date_start": "2000-06-15"}],
           "aggregations": [{"function": "COUNT", "column": "*", "alias": "n"}]}
    return compile_view(catalog(spark, d), cfg)


ARITH = {"alias": "net", "expression_type": "arithmetic",
         "operands": [const(1), col("lineitem", "l_discount"), col("lineitem", "l_extendedprice")],
         "operators": ["-", "*"]}


@reg.add("v_arith", f"""
SELECT l_orderkey, l_linenumber,
       {R('(1 - l_discount) * l_extendedprice', 4)} AS net,
       {R('l_extendedprice / l_quantity + l_tax * 100 - 3', 4)} AS mix
FROM lineitem WHERE (1 - l_discount) * l_extendedprice > 50000""")
def v_arith(spark, d):
    mix = {"alias": "mix", "expression_type": "arithmetic",
           "operands": [col("lineitem", "l_extendedprice"), col("lineitem", "l_quantity"),
                        col("lineitem", "l_tax"), const(100), const("3")],
           "operators": ["/", "+", "*", "-"]}
    # strictly left to right: ((price / qty + tax) * 100) - 3
    cfg = {"from_tables": ["lineitem"], "computed_columns": [ARITH, mix],
           "columns": [{"table": "lineitem", "column": "l_orderkey"},
                       {"table": "lineitem", "column": "l_linenumber"}],
           "selected_computed_columns": ["net", "mix"],
           "filters": [{"column": "net", "operator": "gt", "value": 50000}]}
    return rounded(compile_view(catalog(spark, d), cfg), 4)


# the oracle for v_arith has to follow the strict left-to-right chain
reg.items["v_arith"] = (v_arith, f"""
SELECT l_orderkey, l_linenumber,
       {R('(1 - l_discount) * l_extendedprice', 4)} AS net,
       {R('((l_extendedprice / l_quantity + l_tax) * 100) - 3', 4)} AS mix
FROM lineitem WHERE (1 - l_discount) * l_extendedprice > 50000""")


@reg.add("v_arith_ratio", f"""
SELECT l_orderkey, l_linenumber, {R('l_tax / l_extendedprice * 1000000', 4)} AS ratio FROM lineitem""")
def v_arith_ratio(spark, d):
    ratio = {"alias": "ratio", "expression_type": "arithmetic", "operators": ["/", "*"],
             "operands": [col("lineitem", "l_tax"), col("lineitem", "l_extendedprice"), const(1000000)]}
    cfg = {"from_tables": ["lineitem"], "computed_columns": [ratio], "selected_computed_columns": ["ratio"],
           "columns": [{"table": "lineitem", "column": c} for c in ("l_orderkey", "l_linenumber")]}
    return rounded(compile_view(catalog(spark, d), cfg), 4)


@reg.add("v_agg_computed", f"""
SELECT l_returnflag, {R('SUM((1 - l_discount) * l_extendedprice)')} AS revenue,
       {R('AVG((1 - l_discount) * l_extendedprice)')} AS avg_net,
       {R('MAX((1 - l_discount) * l_extendedprice)')} AS max_net
FROM lineitem GROUP BY 1""")
def v_agg_computed(spark, d):
    cfg = {"from_tables": ["lineitem"], "computed_columns": [ARITH],
           "group_by": ["l_returnflag"],
           "aggregations": [{"function": "SUM", "column": "net", "alias": "revenue"},
                            {"function": "AVG", "column": "net", "alias": "avg_net"},
                            {"function": "MAX", "column": "net", "alias": "max_net"}]}
    return rounded(compile_view(catalog(spark, d), cfg))


@reg.add("v_shift", """
SELECT o_orderkey,
       o_orderdate + INTERVAL 1 MONTH + INTERVAL 15 DAY AS plus_1_5_months,
       o_orderdate - INTERVAL 2 DAY - INTERVAL 12 HOUR AS minus_2_5_days,
       o_orderdate + INTERVAL 1 YEAR AS plus_year,
       o_orderdate + INTERVAL 18 MONTH AS plus_1_5_years
FROM orders""")
def v_shift(spark, d):
    def sh(alias, v, unit):
        return {"alias": alias, "expression_type": "datetime_shift",
                "base_column": col("orders", "o_orderdate"), "shift_value": str(v),
                "shift_unit": unit}
    cc = [sh("plus_1_5_months", 1.5, "months"), sh("minus_2_5_days", -2.5, "days"),
          sh("plus_year", 1, "years"), sh("plus_1_5_years", 1.5, "years")]
    cfg = {"from_tables": ["orders"], "computed_columns": cc,
           "columns": [{"table": "orders", "column": "o_orderkey"}],
           "selected_computed_columns": [c["alias"] for c in cc]}
    return compile_view(catalog(spark, d), cfg)


def _trunc_query(unit, table="orders", column="o_orderdate"):
    def fn(spark, d):
        cfg = {"from_tables": [table],
               "computed_columns": [{"alias": "bucket", "expression_type": "datetime_trunc",
                                     "trunc_column": col(table, column), "trunc_unit": unit}],
               "group_by": ["bucket"],
               "aggregations": [{"function": "COUNT", "column": "*", "alias": "n"}]}
        return compile_view(catalog(spark, d), cfg)
    sql = f"""SELECT CAST(date_trunc('{unit}', {column}) AS TIMESTAMP) AS bucket,
COUNT(*) AS n FROM {table} GROUP BY 1"""
    return fn, sql


for _u in ("year", "quarter", "month", "week", "day"):
    reg.items[f"v_trunc_{_u}"] = _trunc_query(_u)
for _u in ("hour", "minute"):
    reg.items[f"v_trunc_{_u}"] = _trunc_query(_u, "events", "ts")


@reg.add("v_agg", f"""
SELECT l_returnflag, l_linestatus, {R('SUM(l_quantity)')} AS sum_qty,
       {R('AVG(l_extendedprice)')} AS avg_price, {R('MIN(l_discount)')} AS min_disc,
       {R('MAX(l_tax)')} AS max_tax, COUNT(l_orderkey) AS count_l_orderkey,
       COUNT(*) AS count_order, MIN(l_shipdate) AS first_ship
FROM lineitem GROUP BY 1, 2""")
def v_agg(spark, d):
    cfg = {"from_tables": ["lineitem"], "group_by": ["l_returnflag", "l_linestatus"],
           "aggregations": [{"function": "SUM", "column": "l_quantity", "alias": "sum_qty"},
                            {"function": "avg", "column": "l_extendedprice", "alias": "avg_price"},
                            {"function": "MIN", "column": "l_discount", "alias": "min_disc"},
                            {"function": "MAX", "column": "l_tax", "alias": "max_tax"},
                            {"function": "COUNT", "column": "l_orderkey"},
                            {"function": "COUNT", "column": "*", "alias": "count_order"},
                            {"function": "MIN", "column": "l_shipdate", "alias": "first_ship"}]}
    return rounded(compile_view(catalog(spark, d), cfg))


@reg.add("v_group_computed", f"""
SELECT c_mktsegment, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS quarter,
       {R('SUM(o_totalprice)')} AS total, COUNT(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def v_group_computed(spark, d):
    cfg = {"from_tables": ["orders"],
           "joins": [{"left_table": "orders", "right_table": "customer",
                      "left_key": "o_custkey", "right_key": "c_custkey"}],
           "computed_columns": [{"alias": "quarter", "expression_type": "datetime_trunc",
                                 "trunc_column": col("orders", "o_orderdate"),
                                 "trunc_unit": "quarter"}],
           "group_by": ["quarter", "c_mktsegment"],
           "aggregations": [{"function": "SUM", "column": "o_totalprice", "alias": "total"},
                            {"function": "COUNT", "column": "*", "alias": "n"}]}
    return rounded(compile_view(catalog(spark, d), cfg))


@reg.add("v_distinct_group", """
SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders""")
def v_distinct_group(spark, d):
    cfg = {"from_tables": ["orders"], "group_by": ["o_orderstatus", "o_orderpriority"]}
    return compile_view(catalog(spark, d), cfg)


@reg.add("v_global", f"""
SELECT {R('SUM(o_totalprice)')} AS total, COUNT(*) AS n, {R('AVG(o_totalprice)')} AS mean,
       MAX(o_orderdate) AS last_order FROM orders""")
def v_global(spark, d):
    cfg = {"from_tables": ["orders"],
           "aggregations": [{"function": "SUM", "column": "o_totalprice", "alias": "total"},
                            {"function": "COUNT", "column": "*", "alias": "n"},
                            {"function": "AVG", "column": "o_totalprice", "alias": "mean"},
                            {"function": "MAX", "column": "o_orderdate", "alias": "last_order"}]}
    return rounded(compile_view(catalog(spark, d), cfg))


SORTED = {"from_tables": ["orders"],
          "columns": [{"table": "orders", "column": c}
                      for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")],
          "order_by": [{"column": "o_totalprice", "direction": "desc"},
                       {"column": "o_orderkey", "direction": "asc"}],
          "limit": 50}


@reg.add("v_sort_limit", f"""
SELECT o_orderkey, o_custkey, {R('o_totalprice')} AS o_totalprice, o_orderdate FROM orders
ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey ASC NULLS LAST LIMIT 50""")
def v_sort_limit(spark, d):
    return rounded(compile_view(catalog(spark, d), SORTED))


@reg.add("v_top_groups", f"""
SELECT o_custkey, {R('SUM(o_totalprice)')} AS spend, COUNT(*) AS n FROM orders
GROUP BY 1 ORDER BY spend DESC, o_custkey LIMIT 25""")
def v_top_groups(spark, d):
    cfg = {"from_tables": ["orders"], "group_by": ["o_custkey"],
           "aggregations": [{"function": "SUM", "column": "o_totalprice", "alias": "spend"},
                            {"function": "COUNT", "column": "*", "alias": "n"}],
           "order_by": [{"column": "spend", "direction": "desc"},
                        {"column": "o_custkey", "direction": "asc"}],
           "limit": 25}
    return rounded(compile_view(catalog(spark, d), cfg))


@reg.add("v_page", f"""
SELECT o_orderkey, o_custkey, {R('o_totalprice')} AS o_totalprice, o_orderdate FROM (
  SELECT * FROM (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders
                 ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey, o_custkey, o_totalprice,
                          o_orderdate LIMIT 50)
  ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey, o_custkey, o_totalprice, o_orderdate
  LIMIT 20 OFFSET 40)""")
def v_page(spark, d):
    # third page of 20 inside a cap of 50: the last 10 rows of the top 50
    return rounded(view_page(catalog(spark, d), SORTED, page=3, size=20))


@reg.add("v_page_deep", f"""
SELECT l_orderkey, l_linenumber, {R('l_extendedprice')} AS l_extendedprice FROM lineitem
ORDER BY lineitem.l_extendedprice DESC NULLS FIRST, l_orderkey, l_linenumber LIMIT 5 OFFSET 49995""")
def v_page_deep(spark, d):
    # page 10,000 of 5
    cfg = {"from_tables": ["lineitem"],
           "columns": [{"table": "lineitem", "column": c} for c in ("l_orderkey", "l_linenumber", "l_extendedprice")],
           "order_by": [{"column": "l_extendedprice", "direction": "desc"}]}
    return rounded(view_page(catalog(spark, d), cfg, page=10_000, size=5))


@reg.add("v_total", """
SELECT LEAST(COUNT(*), 50) AS total FROM orders""")
def v_total(spark, d):
    return view_total(catalog(spark, d), SORTED)


@reg.add("v_total_uncapped", """
SELECT COUNT(*) AS total FROM orders WHERE o_orderstatus = 'O'""")
def v_total_uncapped(spark, d):
    cfg = {"from_tables": ["orders"], "columns": [{"table": "orders", "column": "o_orderkey"}],
           "filters": [{"column": "o_orderstatus", "operator": "eq", "value": "O"}]}
    return view_total(catalog(spark, d), cfg)


@reg.add("v_preview", f"""
SELECT o_orderkey, o_custkey, {R('o_totalprice')} AS o_totalprice, o_orderdate FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def v_preview(spark, d):
    return rounded(preview(catalog(spark, d), SORTED))
