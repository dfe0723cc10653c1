"""Registered upsert and integrity queries.

Scenario, derived from ``orders`` on both sides: the stored table holds the
orders placed before 2000; an incremental file holds the orders from 1999 on
(one year overlaps), with URGENT prices raised by 1 and the status of LOW
orders from 2001 blanked (a required column). So every action occurs:
inserts (2000+), updates (1999 URGENT), skips (other 1999), rejects.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import ColumnSpec, TableSpec
from ..operators import cleaning as C
from ..operators import upsert as U
from ..catalog import Catalog
from ..plans.imports import import_frame
from ..plans.saved import import_history
from ..session import cut_lineage, scratch_path
from ..sources.schema import create_table
from ..versions import JobLog
from .common import R, Registry, catalog, rounded

reg = Registry()

SPEC = TableSpec("orders", [
    ColumnSpec("o_orderkey", "BigInteger", primary_key=True, nullable=False),
    ColumnSpec("o_custkey", "BigInteger"),
    ColumnSpec("o_orderstatus", "String", 1, nullable=False),
    ColumnSpec("o_totalprice", "Numeric"),
    ColumnSpec("o_orderdate", "DateTime"),
    ColumnSpec("o_orderpriority", "String", 15, default="3-MEDIUM")])


def target(spark, d):
    o = catalog(spark, d).table("orders").filter(F.col("o_orderdate") < F.lit("2000-01-01")
                                                  .cast("timestamp_ntz"))
    return o.select(*[F.col(c.name).cast(c.spark_type()).alias(c.name) for c in SPEC.columns])


def source_text(spark, d, with_priority=True):
    o = catalog(spark, d).table("orders").filter(F.col("o_orderdate") >= F.lit("1999-01-01")
                                                  .cast("timestamp_ntz"))
    p = F.col("o_orderpriority")
    price = F.when(p == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    status = F.when((p == "5-LOW") & (F.col("o_orderdate") >= F.lit("2001-01-01")
                                       .cast("timestamp_ntz")), F.lit("null")) \
              .otherwise(F.col("o_orderstatus"))
    cols = [F.col("o_orderkey").cast("string").alias("o_orderkey"),
            F.col("o_custkey").cast("string").alias("o_custkey"), status.alias("o_orderstatus"),
            price.cast("string").alias("o_totalprice"),
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate")]
    if with_priority:
        cols.append(p.alias("o_orderpriority"))
    return o.select(*cols, F.col("o_orderkey").alias(C.ORDINAL))


def typed_source(spark, d, with_priority=True):
    """The cleaned, typed file, materialised once as the import plan does
    (its consumers - size check, classify, merge, reject log - reuse it)."""
    df, _ = C.clean(source_text(spark, d, with_priority), key=["o_orderkey"])
    return cut_lineage(U.reject_null_keys(U.coerce(df, SPEC), ["o_orderkey"]))


SRC_SQL = """s AS (SELECT o_orderkey, o_custkey,
      CASE WHEN o_orderpriority = '5-LOW' AND o_orderdate >= TIMESTAMP '2001-01-01' THEN NULL
           ELSE o_orderstatus END AS o_orderstatus,
      CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END
           AS DECIMAL(12,2)) AS o_totalprice, o_orderdate, o_orderpriority
    FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'),
ok AS (SELECT * FROM s WHERE o_orderstatus IS NOT NULL),
t AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice,
      o_orderdate, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
c AS (SELECT ok.*, CASE WHEN t.o_orderkey IS NULL THEN 'insert'
        WHEN ok.o_custkey IS DISTINCT FROM t.o_custkey OR ok.o_orderstatus IS DISTINCT FROM t.o_orderstatus
          OR ok.o_totalprice IS DISTINCT FROM t.o_totalprice OR ok.o_orderdate IS DISTINCT FROM t.o_orderdate
          OR ok.o_orderpriority IS DISTINCT FROM t.o_orderpriority THEN 'update' ELSE 'skip' END AS action
      FROM ok LEFT JOIN t USING (o_orderkey))"""


@reg.add("u_classify", f"""WITH {SRC_SQL}
SELECT action AS _action, COUNT(*) AS n FROM c GROUP BY 1""")
def u_classify(spark, d):
    good, _bad = U.split_rejects(typed_source(spark, d))
    cl = U.classify(good.drop(U.REJECT), target(spark, d), ["o_orderkey"])
    return cl.groupBy(U.ACTION).agg(F.count(F.lit(1)).alias("n"))


@reg.add("u_merge", f"""WITH {SRC_SQL}
SELECT o_orderkey, {R('o_totalprice')} AS o_totalprice, o_orderstatus FROM t
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM c WHERE action IN ('insert', 'update'))
UNION ALL SELECT o_orderkey, {R('o_totalprice')}, o_orderstatus FROM c
WHERE action IN ('insert', 'update')""")
def u_merge(spark, d):
    good, _bad = U.split_rejects(typed_source(spark, d))
    tgt = target(spark, d).withColumn("imported_at", F.lit(None).cast("timestamp_ntz"))
    # the import plan materialises the classified file once; so does this
    cl = cut_lineage(U.classify(good.drop(U.REJECT), tgt, ["o_orderkey"]))
    merged = U.merge(cl, tgt, ["o_orderkey"], SPEC)
    return rounded(merged.select("o_orderkey", "o_totalprice", "o_orderstatus"))


@reg.add("u_counters", f"""WITH {SRC_SQL}
SELECT (SELECT COUNT(*) FROM s) AS total_rows,
       (SELECT COUNT(*) FROM c WHERE action = 'insert') AS rows_inserted,
       (SELECT COUNT(*) FROM c WHERE action = 'update') AS rows_updated,
       (SELECT COUNT(*) FROM c WHERE action = 'skip') AS rows_skipped,
       (SELECT COUNT(*) FROM s WHERE o_orderstatus IS NULL) AS rows_rejected""")
def u_counters(spark, d):
    cat = Catalog(spark)
    cat.register("orders", target(spark, d).withColumn(
        "imported_at", F.lit(None).cast("timestamp_ntz")), SPEC)
    out = import_frame(cat, "orders", source_text(spark, d), SPEC, write=False)
    c = out.counters()
    return U.import_result(spark, c["total_rows"], c["rows_inserted"], c["rows_updated"],
                           c["rows_skipped"], c["rows_rejected"])


@reg.add("u_rejects", """
SELECT o_orderkey AS "row", 'required value missing: o_orderstatus' AS error FROM orders
WHERE o_orderdate >= TIMESTAMP '2001-01-01' AND o_orderpriority = '5-LOW'""")
def u_rejects(spark, d):
    return U.rejects(typed_source(spark, d))


def stored_orders(spark, d) -> Catalog:
    """A catalog on a fresh folder that holds the orders before 2000 as a stored table."""
    cat = Catalog.open(spark, scratch_path(spark, "catalog"))
    create_table(spark, SPEC, catalog=cat)
    cat.versioned("orders").commit(target(spark, d).withColumn("imported_at", F.lit(None).cast("timestamp_ntz")))
    return cat


@reg.add("u_merge_files", f"""WITH {SRC_SQL}
SELECT o_orderkey, {R('o_totalprice')} AS o_totalprice, o_orderstatus FROM t
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM c WHERE action IN ('insert', 'update'))
UNION ALL SELECT o_orderkey, {R('o_totalprice')}, o_orderstatus FROM c
WHERE action IN ('insert', 'update')""")
def u_merge_files(spark, d):
    """The import of the scenario into a stored table, read back through its newest version."""
    cat = stored_orders(spark, d)
    import_frame(cat, "orders", source_text(spark, d), SPEC)
    again = Catalog.open(spark, cat.root)
    return rounded(again.table("orders").select("o_orderkey", "o_totalprice", "o_orderstatus"))


@reg.add("s_history", f"""WITH {SRC_SQL}, n AS (
SELECT (SELECT COUNT(*) FROM s) AS total_rows,
       (SELECT COUNT(*) FROM c WHERE action = 'insert') AS rows_inserted,
       (SELECT COUNT(*) FROM c WHERE action = 'update') AS rows_updated,
       (SELECT COUNT(*) FROM c WHERE action = 'skip') AS rows_skipped,
       (SELECT COUNT(*) FROM s WHERE o_orderstatus IS NULL) AS rows_rejected)
SELECT 'first' AS id, 'orders of 1999 on' AS source_name, n.*, rows_rejected AS stored_rejects FROM n
UNION ALL SELECT 'second', 'orders of 1999 on', total_rows, 0, 0, total_rows - rows_rejected, rows_rejected, rows_rejected
FROM n""")
def s_history(spark, d):
    """Two imports of the same file with a stored job log, as another session reads it."""
    cat = stored_orders(spark, d)
    for run in ("first", "second"):
        import_frame(cat, "orders", source_text(spark, d), SPEC, log=JobLog(spark, f"{cat.root}/log"), run=run, source_id="f1")
    log = JobLog(spark, f"{cat.root}/log")
    sources = spark.createDataFrame([("f1", "orders of 1999 on", "csv")], "id string, name string, source_type string")
    page, _total = import_history(log.jobs(), sources)
    rejected = spark.read.option("basePath", f"{cat.root}/log/rejects").parquet(f"{cat.root}/log/rejects/run=*") \
        .groupBy(F.col("run").alias("id")).agg(F.count(F.lit(1)).alias("stored_rejects"))
    return page.join(rejected, "id").select("id", "source_name", "total_rows", "rows_inserted", "rows_updated",
                                            "rows_skipped", "rows_rejected", "stored_rejects")


EVENT_SPEC = TableSpec("events", [
    ColumnSpec("event_id", "BigInteger"), ColumnSpec("ts", "DateTime"),
    ColumnSpec("user_id", "BigInteger"), ColumnSpec("event_type", "String", 20),
    ColumnSpec("value", "Numeric"), ColumnSpec("props", "Text")])

_HASH_SQL = """sha256('{"event_id": ' || CAST(event_id AS VARCHAR)
  || ', "event_type": ' || CAST(to_json(event_type) AS VARCHAR)
  || ', "props": ' || CAST(to_json(props) AS VARCHAR)
  || ', "ts": "' || CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END
  || '", "user_id": ' || CAST(user_id AS VARCHAR)
  || ', "value": ' || CAST(value AS VARCHAR) || '}')"""


def hashed_events(spark, d):
    ev = catalog(spark, d).table("events")
    typed = ev.select(*[F.col(c.name).cast(c.spark_type()).alias(c.name)
                        for c in EVENT_SPEC.columns], F.col("event_id").alias(C.ORDINAL))
    return U.with_content_hash(typed, EVENT_SPEC)


@reg.add("u_hash", f"SELECT event_id, {_HASH_SQL} AS content_hash FROM events")
def u_hash(spark, d):
    return hashed_events(spark, d).select("event_id", "content_hash")


@reg.add("u_insert_new", """
SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'""")
def u_insert_new(spark, d):
    # hashed once and reused by every branch, as the import plan does
    h = cut_lineage(hashed_events(spark, d))
    tgt = h.filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    src = h.filter(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    return U.insert_new(src, tgt).select("event_id")


@reg.add("u_append", f"""
SELECT event_id, event_type, {R('value')} AS value FROM events WHERE ts < TIMESTAMP '2024-01-20'
UNION ALL SELECT event_id, event_type, {R('value')} FROM events WHERE ts >= TIMESTAMP '2024-01-15'""")
def u_append(spark, d):
    """A keyless table without dedup takes every row of the file, as files of its own."""
    spec = TableSpec("events", EVENT_SPEC.columns, dedup=False)
    cat = Catalog.open(spark, scratch_path(spark, "catalog"))
    create_table(spark, spec, catalog=cat)
    ev = catalog(spark, d).table("events").select(*[F.col(c.name).cast(c.spark_type()).alias(c.name) for c in spec.columns])
    at = lambda day: F.lit(day).cast("timestamp_ntz")       # noqa: E731
    cat.versioned("events").commit(ev.filter(F.col("ts") < at("2024-01-20")).withColumn("imported_at", F.lit(None).cast("timestamp_ntz")))
    text = ev.filter(F.col("ts") >= at("2024-01-15")).select(
        *[(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS") if c == "ts" else F.col(c).cast("string")).alias(c) for c in spec.names],
        F.col("event_id").alias(C.ORDINAL))
    import_frame(cat, "events", text, spec)
    return rounded(cat.table("events").select("event_id", "event_type", "value"))


@reg.add("u_fk", """
SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NULL
  THEN 'foreign key l_orderkey=' || CAST(l_orderkey AS VARCHAR) || ' not present in parent' END AS _reject
FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01') p
  ON l_orderkey = p.o_orderkey""")
def u_fk(spark, d):
    li = catalog(spark, d).table("lineitem").select("l_orderkey", "l_linenumber")
    parent = target(spark, d)
    return U.reject_fk(li, "l_orderkey", parent, "o_orderkey").select(
        "l_orderkey", "l_linenumber", U.REJECT)


@reg.add("u_unique", """
WITH s AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'),
f AS (SELECT o_custkey, MIN(o_orderkey) AS first FROM s GROUP BY 1),
t AS (SELECT DISTINCT o_custkey, o_orderkey AS tk FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01')
SELECT s.o_orderkey, CASE WHEN s.o_orderkey != f.first THEN 'duplicate value in unique column o_custkey'
  WHEN EXISTS (SELECT 1 FROM t WHERE t.o_custkey = s.o_custkey AND t.tk != s.o_orderkey)
  THEN 'value already stored in unique column o_custkey' END AS _reject
FROM s JOIN f USING (o_custkey)""")
def u_unique(spark, d):
    src = catalog(spark, d).table("orders").filter(
        F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")).select(
        "o_orderkey", "o_custkey", F.col("o_orderkey").alias(C.ORDINAL)).withColumn(
        U.REJECT, F.lit(None).cast("string"))
    out = U.reject_unique(src, target(spark, d), "o_custkey", ["o_orderkey"])
    return out.select("o_orderkey", U.REJECT)


@reg.add("u_dupkey", """
SELECT MIN(o_custkey) AS o_custkey FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING COUNT(*) > 1)
HAVING COUNT(*) > 0""")
def u_dupkey(spark, d):
    return U.find_duplicate_key(catalog(spark, d).table("orders"), ["o_custkey"])


@reg.add("u_defaults", """
SELECT o_orderkey, '3-MEDIUM' AS o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'
  AND NOT (o_orderpriority = '5-LOW' AND o_orderdate >= TIMESTAMP '2001-01-01')""")
def u_defaults(spark, d):
    good, _ = U.split_rejects(typed_source(spark, d, with_priority=False))
    tgt = target(spark, d)
    cl = U.classify(good.drop(U.REJECT), tgt, ["o_orderkey"])
    ins = cl.filter(F.col(U.ACTION) == "insert")
    return U.fill_defaults(ins, tgt, SPEC).select("o_orderkey", "o_orderpriority")
