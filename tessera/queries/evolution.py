"""Registered table-evolution and saved-view queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import ColumnSpec, TableSpec
from ..operators import evolution as M
from ..plans.saved import ViewStore
from ..sources.schema import table_overview
from ..catalog import Catalog
from ..session import scratch_path
from .common import R, Registry, catalog, rounded
from .views import FLAGSHIP

reg = Registry()

ORDERS = TableSpec("orders", [
    ColumnSpec("o_orderkey", "BigInteger", primary_key=True, nullable=False),
    ColumnSpec("o_custkey", "BigInteger"), ColumnSpec("o_orderstatus", "String", 1),
    ColumnSpec("o_totalprice", "Numeric"), ColumnSpec("o_orderdate", "DateTime"),
    ColumnSpec("o_orderpriority", "String", 15)])


def orders(spark, d):
    return catalog(spark, d).table("orders")


@reg.add("m_add_column", "SELECT o_orderkey, 'web' AS o_channel FROM orders")
def m_add_column(spark, d):
    df, _ = M.add_column(orders(spark, d), ORDERS,
                         ColumnSpec("o_channel", "String", 10, nullable=False, default="web"))
    return df.select("o_orderkey", "o_channel")


@reg.add("m_drop_column", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, {R('o_totalprice')} AS o_totalprice, o_orderdate
FROM orders""")
def m_drop_column(spark, d):
    df, spec = M.drop_column(orders(spark, d), ORDERS, "o_orderpriority")
    assert "o_orderpriority" not in spec.names
    return rounded(df)


@reg.add("m_rename_column", "SELECT p_partkey, p_brand AS brand FROM part")
def m_rename_column(spark, d):
    part = TableSpec("part", [ColumnSpec("p_partkey", "BigInteger", primary_key=True),
                              ColumnSpec("p_brand", "String", 20)])
    df, _ = M.rename_column(catalog(spark, d).table("part").select("p_partkey", "p_brand"),
                            part, "p_brand", "brand")
    return df


@reg.add("m_change_type", """
SELECT 'o_orderstatus' AS "column", 'Integer' AS new_type, TRUE AS lossy,
       COUNT(*) FILTER (WHERE o_orderstatus IS NOT NULL AND TRY_CAST(o_orderstatus AS INTEGER) IS NULL)
       AS lossy_rows FROM orders
UNION ALL SELECT 'o_custkey', 'String', FALSE,
       COUNT(*) FILTER (WHERE o_custkey IS NOT NULL AND TRY_CAST(o_custkey AS VARCHAR) IS NULL) FROM orders
UNION ALL SELECT 'o_totalprice', 'Integer', TRUE,
       COUNT(*) FILTER (WHERE TRY_CAST(round(o_totalprice) AS INTEGER) IS NULL OR round(o_totalprice) <> o_totalprice)
       FROM orders
UNION ALL SELECT 'o_orderdate', 'Date', TRUE,
       COUNT(*) FILTER (WHERE CAST(o_orderdate AS DATE)::TIMESTAMP <> o_orderdate) FROM orders""")
def m_change_type(spark, d):
    out = None
    for col, new_type in (("o_orderstatus", "Integer"), ("o_custkey", "String"),
                          ("o_totalprice", "Integer"), ("o_orderdate", "Date")):
        _df, _spec, lossy, losses = M.change_type(orders(spark, d), ORDERS, col, new_type)
        row = losses.select(F.lit(col).alias("column"), F.lit(new_type).alias("new_type"),
                            F.lit(lossy).alias("lossy"), "lossy_rows")
        out = row if out is None else out.unionByName(row)
    return out


@reg.add("m_null_check", """
SELECT COUNT(*) FILTER (WHERE l_orderkey IS NULL) AS violations
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""")
def m_null_check(spark, d):
    o, li = orders(spark, d), catalog(spark, d).table("lineitem")
    return M.null_violations(o.join(li, o.o_orderkey == li.l_orderkey, "left"), "l_orderkey")


@reg.add("m_set_key", "SELECT o_orderkey, o_custkey FROM orders")
def m_set_key(spark, d):
    df, spec = M.set_key(orders(spark, d), ORDERS, ["o_orderkey"])
    assert spec.key() == ["o_orderkey"]
    return df.select("o_orderkey", "o_custkey")


@reg.add("v_saved", f"""
SELECT o_orderstatus, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS ship_month,
       {R('SUM(l_extendedprice)')} AS revenue, COUNT(*) AS n_lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'
GROUP BY 1, 2""")
def v_saved(spark, d):
    """Save the flagship config by name, load it back, run it."""
    store = ViewStore(spark, scratch_path(spark, "views"))
    store.save("monthly revenue", FLAGSHIP, "lineitem x orders by month")
    return rounded(store.run(catalog(spark, d), "monthly revenue"))


@reg.add("m_versions", f"""
SELECT o_orderkey, o_custkey AS customer, {R('o_totalprice')} AS o_totalprice,
       CASE WHEN o_orderkey % 3 = 0 THEN 'shop' ELSE 'web' END AS channel
FROM orders""")
def m_versions(spark, d):
    """M1-M3 on a stored table without rewriting a file: a third of the rows is stored
    after the column was added, the rest reads as the default."""
    cat = Catalog.open(spark, scratch_path(spark, "catalog"))
    table = cat.create(ORDERS)
    rows = orders(spark, d).select(*[F.col(c.name).cast(c.spark_type()).alias(c.name) for c in ORDERS.columns])
    table.commit(rows.filter("o_orderkey % 3 <> 0"))
    table.add_column(ColumnSpec("o_channel", "String", 10, nullable=False, default="web"))
    table.commit(rows.filter("o_orderkey % 3 = 0").withColumn("o_channel", F.lit("shop")))
    table.drop_column("o_orderpriority").rename_column("o_channel", "channel").rename_column("o_custkey", "customer")
    again = Catalog.open(spark, cat.root).table("orders")
    return rounded(again.select("o_orderkey", "customer", "o_totalprice", "channel"))


@reg.add("m_dependencies", """
SELECT 'view' AS kind, 'by ' || c_name AS name FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_nationkey % 3 <> 0
UNION ALL SELECT 'chart', 'chart of ' || c_name FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_nationkey % 3 <> 0""")
def m_dependencies(spark, d):
    """M8: a view for each customer, of ``orders`` or of a table whose name only begins
    so, as config or as SQL text; a chart on each view. Asked for one column."""
    c = catalog(spark, d).table("customer")
    source = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("orders_old")).otherwise(F.lit("orders"))
    column = F.when(F.col("c_nationkey") % 3 == 0, F.lit("o_total")).otherwise(F.lit("o_totalprice"))
    config = F.to_json(F.struct(F.array(source).alias("from_tables"), F.array(F.struct(column.alias("column"))).alias("columns")))
    text = F.concat(F.lit("SELECT SUM("), column, F.lit(") FROM "), source)
    written = F.col("c_nationkey") % 2 == 0
    views = c.select(F.concat(F.lit("by "), "c_name").alias("name"), F.when(~written, config).alias("config_json"),
                     F.when(written, text).alias("sql"))
    charts = c.select(F.concat(F.lit("chart of "), "c_name").alias("chart"), F.concat(F.lit("by "), "c_name").alias("view_name"))
    found = M.dependent_visualizations(views, charts, "orders", "o_totalprice")
    return M.dependencies(views, "orders", "o_totalprice").select(F.lit("view").alias("kind"), "name").unionByName(
        found.select(F.lit("chart").alias("kind"), F.col("chart").alias("name")))


@reg.add("m_drop_table", """
SELECT 'customer' AS "table", COUNT(*) AS row_count, 2 AS column_count FROM customer""")
def m_drop_table(spark, d):
    """M7: of two stored tables the one that is pointed at stays, the other goes; read by
    a catalog opened anew."""
    cat = Catalog.open(spark, scratch_path(spark, "catalog"))
    people = TableSpec("customer", [ColumnSpec("c_custkey", "BigInteger", primary_key=True, nullable=False),
                                    ColumnSpec("c_name", "String", 40)])
    bought = TableSpec("orders", [ColumnSpec("o_orderkey", "BigInteger", primary_key=True, nullable=False),
                                  ColumnSpec("o_custkey", "BigInteger", fk=("customer", "c_custkey"))])
    for spec in (people, bought):
        rows = catalog(spark, d).table(spec.name)
        cat.create(spec).commit(rows.select(*[F.col(c.name).cast(c.spark_type()).alias(c.name) for c in spec.columns]))
    try:
        M.drop_table(cat, "customer")
    except M.EvolutionError:
        M.drop_table(cat, "orders")
    return table_overview(Catalog.open(spark, cat.root))
