"""Registered cleaning and source queries.

Inputs are text versions of the driver tables, derived the same way on both
sides (Spark expressions here, SQL in the oracle), with dirt placed by data
attributes (order priority, status) rather than by row ids.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import ColumnSpec, TableSpec
from ..operators import cleaning as C
from ..operators import upsert as U
from ..operators.table_rules import EXPORTS
from ..sources.delimited import read_delimited
from ..sources.schema import infer_schema, map_headers, table_overview
from ..session import scratch_path
from .common import Registry, catalog

reg = Registry()

# the same whitespace class in RE2 (oracle) syntax
WS = C.WS


def strip_sql(c):
    s = "regexp_replace(" + c + ", '^" + WS + "+|" + WS + "+$', '', 'g')"
    return "CASE WHEN " + s + " IN ('nan', 'null', 'None', '') THEN NULL ELSE " + s + " END"


def docs(spark, d):
    return catalog(spark, d).table("documents")


@reg.add("c_strip", f"""
SELECT doc_id, sha256({strip_sql('text')}) AS text_hash, length({strip_sql('text')}) AS n,
       {strip_sql('lang')} AS lang FROM documents""")
def c_strip(spark, d):
    df = docs(spark, d).select("doc_id", "text", "lang")
    out = C.strip_whitespace(df, C.CleaningReport())
    return out.select("doc_id", F.sha2("text", 256).alias("text_hash"),
                      F.length("text").cast("long").alias("n"), "lang")


_CLEAN_BASE = f"""
WITH s AS (SELECT {strip_sql('text')} AS text, {strip_sql('lang')} AS lang,
                  {strip_sql('source')} AS source,
                  (CASE WHEN text IS NOT NULL AND ({strip_sql('text')} IS NULL OR {strip_sql('text')} != text) THEN 1 ELSE 0 END
                 + CASE WHEN lang IS NOT NULL AND ({strip_sql('lang')} IS NULL OR {strip_sql('lang')} != lang) THEN 1 ELSE 0 END
                 + CASE WHEN source IS NOT NULL AND ({strip_sql('source')} IS NULL OR {strip_sql('source')} != source) THEN 1 ELSE 0 END) AS chg
           FROM documents),
k AS (SELECT * FROM s WHERE text IS NOT NULL OR lang IS NOT NULL OR source IS NOT NULL),
n AS (SELECT (SELECT COUNT(*) FROM documents) AS n0, (SELECT SUM(chg) FROM s) AS chg,
             (SELECT COUNT(*) FROM k) AS n1,
             (SELECT COUNT(*) FROM (SELECT DISTINCT text, lang, source FROM k)) AS n2)"""


@reg.add("c_report", _CLEAN_BASE + """
SELECT 'strip_whitespace' AS step, n0 AS rows_before, n0 AS rows_after, 0 AS rows_dropped,
       CAST(chg AS BIGINT) AS rows_modified FROM n
UNION ALL SELECT 'handle_missing_values', n0, n1, n0 - n1, 0 FROM n
UNION ALL SELECT 'normalize_formats', n1, n1, 0, 0 FROM n
UNION ALL SELECT 'deduplicate_rows', n1, n2, n1 - n2, 0 FROM n
UNION ALL SELECT 'validate_values', n2, n2, 0, 0 FROM n""")
def c_report(spark, d):
    df = docs(spark, d).select("text", "lang", "source",
                               F.col("_metadata.row_index").alias(C.ORDINAL))
    out, report = C.clean(df)
    out.write.format("noop").mode("overwrite").save()      # one run fills the report
    return report.to_frame(spark).drop("warnings")


@reg.add("c_dedup", f"""
SELECT DISTINCT sha256({strip_sql('text')}) AS text_hash, {strip_sql('lang')} AS lang
FROM documents""")
def c_dedup(spark, d):
    df = docs(spark, d).select("text", "lang", F.col("doc_id").alias(C.ORDINAL))
    out = C.dedup_rows(C.strip_whitespace(df, C.CleaningReport()), C.CleaningReport())
    return out.select(F.sha2("text", 256).alias("text_hash"), "lang")


@reg.add("c_dedup_key", """
SELECT sha256(text) AS text_hash, arg_max(doc_id, doc_id) AS doc_id, arg_max(lang, doc_id) AS lang
FROM documents GROUP BY text""")
def c_dedup_key(spark, d):
    # "last in file wins": the ordinal is the document id
    df = docs(spark, d).select("text", "lang", "doc_id", F.col("doc_id").alias(C.ORDINAL))
    out = C.dedup_by_key(df, ["text"])
    return out.select(F.sha2("text", 256).alias("text_hash"), "doc_id", "lang")


def dated_orders(spark, d):
    """orders with a text date in mixed formats and a mostly-unparseable column."""
    o = catalog(spark, d).table("orders")
    return o.select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format("o_orderdate", "yyyy/MM/dd"))
         .when(F.col("o_orderpriority") == "5-LOW", F.lit("n/a"))
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"),
        F.when(F.col("o_orderpriority") == "2-HIGH",
               F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
         .otherwise(F.lit("x")).alias("t2"))


_DATED_SQL = """
SELECT o_orderkey,
  CASE WHEN o_orderpriority NOT IN ('1-URGENT', '5-LOW') THEN o_orderdate END AS d,
  {t2} AS t2 FROM orders"""


@reg.add("c_dates", _DATED_SQL.format(
    t2="CASE WHEN o_orderpriority = '2-HIGH' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE 'x' END"))
def c_dates(spark, d):
    return C.normalize_dates(dated_orders(spark, d), C.CleaningReport())


@reg.add("c_dates_compat", _DATED_SQL.format(
    t2="CASE WHEN o_orderpriority = '2-HIGH' THEN o_orderdate END"))
def c_dates_compat(spark, d):
    # the original's absolute threshold converts a column where only 1 in 5
    # cells is a date, losing the rest
    return C.normalize_dates(dated_orders(spark, d), C.CleaningReport(), compat=True)


def raw_orders(spark, d):
    """orders as positional text cells, with broken keys and short rows."""
    o = catalog(spark, d).table("orders")
    short = F.col("o_orderpriority") == "4-NOT SPECIFIED"
    return o.select(
        F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("WX"), F.col("o_orderkey")))
         .otherwise(F.concat(F.lit("RB"), F.col("o_orderkey"))).alias("_c0"),
        F.col("o_orderstatus").alias("_c1"),
        F.when(~short, F.col("o_totalprice").cast("string")).alias("_c2"),
        F.when(~short, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("_c3"),
        F.when(~short, F.col("o_orderpriority")).alias("_c4"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("x")).alias("_c5"),
        F.when(F.col("o_orderstatus") == "F", F.lit("y")).otherwise(F.lit(" ")).alias("_c6"))


@reg.add("c_malformed", """
SELECT 'RB' || CAST(o_orderkey AS VARCHAR) AS _c0, o_orderstatus AS _c1 FROM orders
WHERE o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED')""")
def c_malformed(spark, d):
    df = raw_orders(spark, d)
    out = C.drop_malformed(df, C.CleaningReport(), r"^(RB|RE|RF)\d+$")
    return out.select("_c0", "_c1")


@reg.add("c_overflow", """
WITH b AS (SELECT o_orderkey, o_orderpriority AS c4,
             CASE WHEN o_orderpriority = '1-URGENT' THEN 'x' END AS c5,
             CASE WHEN o_orderstatus = 'F' THEN 'y' ELSE ' ' END AS c6 FROM orders),
m1 AS (SELECT o_orderkey, c4, CASE WHEN c6 IS NOT NULL AND trim(c6) != ''
             THEN COALESCE(c5, '') || ',' || c6 ELSE c5 END AS c5 FROM b)
SELECT o_orderkey, CASE WHEN c5 IS NOT NULL AND trim(c5) != '' THEN COALESCE(c4, '') || ',' || c5
       ELSE c4 END AS c4 FROM m1""")
def c_overflow(spark, d):
    o = catalog(spark, d).table("orders")
    df = o.select("o_orderkey", F.col("o_orderpriority").alias("c4"),
                  F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("x")).alias("c5"),
                  F.when(F.col("o_orderstatus") == "F", F.lit("y")).otherwise(F.lit(" "))
                  .alias("c6"))
    return C.merge_overflow(df, C.CleaningReport(), expected=2)


ORDER_SPEC = TableSpec("orders_copy", [
    ColumnSpec("o_orderkey", "BigInteger", primary_key=True, nullable=False),
    ColumnSpec("o_custkey", "BigInteger"),
    ColumnSpec("o_orderstatus", "String", 1, nullable=False),
    ColumnSpec("o_totalprice", "Numeric"),
    ColumnSpec("o_orderdate", "DateTime"),
    ColumnSpec("o_orderpriority", "String", 8)])


def text_orders(spark, d):
    """orders as file text: keys with fractions or padding, null tokens."""
    o = catalog(spark, d).table("orders")
    p = F.col("o_orderpriority")
    key = (F.when(p == "2-HIGH", F.concat(F.col("o_orderkey"), F.lit(".9")))
            .when(p == "3-MEDIUM", F.concat(F.lit(" "), F.col("o_orderkey"), F.lit(" ")))
            .otherwise(F.col("o_orderkey").cast("string")))
    status = F.when(p == "5-LOW", F.lit("NULL")).otherwise(F.col("o_orderstatus"))
    date = F.when(p == "1-URGENT", F.date_format("o_orderdate", "yyyy/M/d"))\
            .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return o.select(key.alias("o_orderkey"), F.col("o_custkey").cast("string").alias("o_custkey"),
                    status.alias("o_orderstatus"),
                    F.col("o_totalprice").cast("string").alias("o_totalprice"),
                    date.alias("o_orderdate"), p.alias("o_orderpriority"))


@reg.add("c_coerce", """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderstatus END
       AS o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice,
       CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, substr(o_orderpriority, 1, 8) AS o_orderpriority,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'required value missing: o_orderstatus' END AS _reject
FROM orders""")
def c_coerce(spark, d):
    out = U.coerce(text_orders(spark, d), ORDER_SPEC)
    return out.withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


def _infer_sql(cols):
    """Oracle for S7 on text copies of orders: the same rules written in SQL
    (int pattern and range, decimal pattern, the four date shapes, lengths)."""
    parts = []
    for c in cols:
        v = f"NULLIF(trim(CAST({c} AS VARCHAR)), '')"
        dt_any = (f"regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}} [0-9]{{1,2}}:[0-9]{{1,2}}:[0-9]{{1,2}}')"
                  f" OR regexp_full_match({v}, '[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}} [0-9]{{1,2}}:[0-9]{{1,2}}:[0-9]{{1,2}}')")
        d_any = (f"regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}')"
                 f" OR regexp_full_match({v}, '[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}')")
        parts.append(f"""SELECT '{c}' AS name,
  CASE WHEN COUNT({v}) = 0 THEN 'String'
       WHEN bool_and(regexp_full_match({v}, '-?[0-9]+')) THEN
         CASE WHEN MAX(abs(TRY_CAST({v} AS HUGEINT))) > 2147483647 THEN 'BigInteger' ELSE 'Integer' END
       WHEN bool_and(regexp_full_match({v}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')) THEN 'Numeric'
       WHEN bool_and({dt_any} OR {d_any}) THEN CASE WHEN bool_or({dt_any}) THEN 'DateTime' ELSE 'Date' END
       WHEN MAX(length({v})) <= 200 THEN 'String' ELSE 'Text' END AS type,
  CASE WHEN COUNT({v}) = 0 THEN 255
       WHEN bool_and(regexp_full_match({v}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?'))
         OR bool_and({dt_any} OR {d_any}) THEN NULL
       WHEN MAX(length({v})) <= 200 THEN LEAST(255, GREATEST(2 * MAX(length({v})), 50)) END AS length
FROM orders""")
    return "\nUNION ALL ".join(parts)


ORDER_COLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
              "o_orderpriority")


@reg.add("s_infer", _infer_sql(ORDER_COLS))
def s_infer(spark, d):
    o = catalog(spark, d).table("orders")
    headers = o.columns
    txt = o.select(*[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(headers)])
    specs = infer_schema(txt, headers)
    return spark.createDataFrame([(s.name, s.type, s.length) for s in specs],
                                 "name string, type string, length long")


@reg.add("s_read_csv", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
       CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer""")
def s_read_csv(spark, d):
    """Write customer as delimited text files (one per task, each
    with a header) and read them back through the file scan."""
    path = scratch_path(spark, "customer-csv")
    catalog(spark, d).table("customer").write.option("header", True).csv(path)
    raw = read_delimited(spark, path, encoding="utf-8")
    return raw.named().drop("_source_file", "_ordinal")


TABLES = {"benchmark": 2, "conversations": 4, "customer": 5, "documents": 5, "embeddings": 3, "events": 6, "labels": 3,
          "lineitem": 11, "nation": 3, "orders": 6, "pages": 3, "part": 6, "region": 2, "supplier": 4}


@reg.add("s_overview", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", COUNT(*) AS row_count, {n} AS column_count FROM {t}" for t, n in TABLES.items()))
def s_overview(spark, d):
    """S10 over all tables of the folder; the counts come from file footers alone."""
    return table_overview(catalog(spark, d))


# --- the file scan on files derived from customer ---------------------------

@reg.add("s_ragged", """
SELECT CAST(c_custkey AS VARCHAR) AS k, 1 + c_custkey % 40 AS n_extra, 'LOST' || c_custkey AS last FROM customer""")
def s_ragged(spark, d):
    """S3: rows of 0 to 39 cells beyond the header, most of them blank; the last one counts."""
    path = scratch_path(spark, "ragged")
    blanks = F.repeat(F.lit(","), (F.col("c_custkey") % 40).cast("int"))
    catalog(spark, d).table("customer").select(
        F.concat("c_custkey", F.lit(","), "c_name", F.lit(","), blanks, F.lit("LOST"), "c_custkey").alias("c_custkey,c_name")
    ).write.option("header", True).option("sep", ";").csv(path)
    raw = read_delimited(spark, path)
    return raw.df.select(F.col("_c0").alias("k"), F.array_size("_more").cast("long").alias("n_extra"),
                         F.element_at("_more", -1).alias("last"))


@reg.add("s_encodings", """
SELECT CAST(c_custkey AS VARCHAR) AS k, CASE c_custkey % 3 WHEN 0 THEN '客户 ' WHEN 1 THEN '客户é ' ELSE 'café ' END
       || c_name AS name FROM customer""")
def s_encodings(spark, d):
    """Three folders in GBK, UTF-8 and Latin-1, read together."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    c = catalog(spark, d).table("customer")
    paths = []
    for i, (charset, prefix) in enumerate((("GBK", "客户 "), ("UTF-8", "客户é "), ("ISO-8859-1", "café "))):
        paths.append(scratch_path(spark, "encoded"))
        c.filter(F.col("c_custkey") % 3 == i).select("c_custkey", F.concat(F.lit(prefix), "c_name").alias("c_name")) \
            .write.option("header", True).option("encoding", charset).csv(paths[-1])
    return read_delimited(spark, paths).df.select(F.col("_c0").alias("k"), F.col("_c1").alias("name"))


@reg.add("s_mixed_headers", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer""")
def s_mixed_headers(spark, d):
    """Files that name the same columns in another order."""
    c, paths = catalog(spark, d).table("customer"), []
    for i, cols in enumerate((("c_custkey", "c_name", "c_mktsegment"), ("c_mktsegment", "c_custkey", "c_name"))):
        paths.append(scratch_path(spark, "mixed"))
        c.filter(F.col("c_custkey") % 2 == i).select(*cols).write.option("header", True).csv(paths[-1])
    return read_delimited(spark, paths).named().select("c_custkey", "c_name", "c_mktsegment")


@reg.add("s_file_order", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'late' ELSE 'early' END AS origin
FROM customer""")
def s_file_order(spark, d):
    """The last row of a key wins, in the order in which the caller names the files."""
    c = catalog(spark, d).table("customer")
    early, late = scratch_path(spark, "order"), scratch_path(spark, "order")
    c.select("c_custkey", F.lit("early").alias("origin")).write.option("header", True).csv(early)
    c.filter(F.col("c_custkey") % 4 == 0).coalesce(1).select("c_custkey", F.lit("late").alias("origin")) \
        .write.option("header", True).csv(late)
    both = read_delimited(spark, [early, late]).named()
    return C.dedup_by_key(both, ["c_custkey"]).select("c_custkey", "origin")


@reg.add("s_blank_lines", """
SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS name FROM customer WHERE c_custkey % 3 <> 0""")
def s_blank_lines(spark, d):
    """Rows whose cells are all blank (wide spaces too) are dropped."""
    path = scratch_path(spark, "blank")
    gone = F.col("c_custkey") % 3 == 0
    catalog(spark, d).table("customer").select(
        F.when(gone, F.lit("\u3000 ")).otherwise(F.col("c_custkey").cast("string")).alias("k"),
        F.when(gone, F.lit(" ")).otherwise(F.col("c_name")).alias("name")).write.option("header", True).csv(path)
    return read_delimited(spark, path).df.select(F.col("_c0").alias("k"), F.col("_c1").alias("name"))


@reg.add("c_malformed_cells", """
SELECT 'RB' || c_custkey AS k FROM customer WHERE c_custkey % 5 <> 0""")
def c_malformed_cells(spark, d):
    """Rows that are short in the file go, rows whose cells are there but blank stay."""
    path = scratch_path(spark, "malformed")
    short = F.col("c_custkey") % 5 == 0
    catalog(spark, d).table("customer").select(
        F.concat(F.lit("RB"), "c_custkey", F.when(short, F.lit("")).otherwise(F.repeat(F.lit(","), F.lit(9)))).alias("k,a,b,c,d,e,f,g,h,i")
    ).write.option("header", True).option("sep", ";").csv(path)
    raw = read_delimited(spark, path)
    return C.drop_malformed(raw.df, C.CleaningReport(), r"^RB\d+$", columns=raw.data_columns).select(F.col("_c0").alias("k"))


_MORE_REMARK = "CASE WHEN o_orderstatus = 'F' THEN ',left,over' ELSE '' END"


@reg.add("c_rules", f"""
SELECT 'refund_orders' AS "table", 'RB' || o_orderkey AS k, o_orderpriority || {_MORE_REMARK} AS remark FROM orders
WHERE o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW')
UNION ALL SELECT 'service_refund_work_orders', 'GD' || o_orderkey, o_orderpriority || {_MORE_REMARK} FROM orders
WHERE o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW')
UNION ALL SELECT 'wallet_withdrawals', CASE WHEN o_orderpriority = '5-LOW' THEN 'WX' ELSE 'W' END || o_orderkey,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority || {_MORE_REMARK} END FROM orders""")
def c_rules(spark, d):
    """Exports of three tables, with rows that end early, rows whose number is
    none and remarks that hold commas or end in one, through each table's own rules."""
    out = None
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    orders = catalog(spark, d).table("orders").select("o_orderkey", status, priority)
    # A file of the table may be one row group, which one task reads: it would be one file of each export.
    orders = orders.repartition(max(orders.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))
    for name, (cells, prefixes) in EXPORTS.items():
        number = F.concat(F.when(priority == "5-LOW", F.lit("WX")).otherwise(F.lit((*prefixes, "W")[0])), "o_orderkey")
        beyond = F.when(status == "F", F.lit(",left,over")).when(status == "O", F.lit(", ")).otherwise(F.lit(""))
        rest = F.when(priority == "4-NOT SPECIFIED", F.lit(",x")).otherwise(
            F.concat(F.repeat(F.lit(",x"), F.lit(cells - 2)), F.lit(","), priority, beyond))
        path = scratch_path(spark, name)
        orders.select(F.concat(number, rest).alias(",".join(f"h{i}" for i in range(cells)))) \
            .write.option("header", True).option("sep", ";").csv(path)
        raw = read_delimited(spark, path)
        got = C.apply_rules(raw.df, name, C.CleaningReport())
        part = got.select(F.lit(name).alias("table"), F.col("_c0").alias("k"), F.col(f"_c{cells - 1}").alias("remark"))
        out = part if out is None else out.unionByName(part)
    return out


LABELLED = TableSpec("customer_copy", [
    ColumnSpec("c_custkey", "BigInteger", primary_key=True, nullable=False, label="Number"),
    ColumnSpec("c_name", "String", 40, label="Name"), ColumnSpec("c_alias", "String", 40, label="Name"),
    ColumnSpec("c_mktsegment", "String", 20, nullable=False), ColumnSpec("c_note", "String", 20, label="Note")])


@reg.add("s_headers", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, 'alias ' || c_custkey AS c_alias, c_mktsegment FROM customer""")
def s_headers(spark, d):
    """Headers found by label, two equal labels by position, one by column name, in
    another order than the table's; a column that may be null is not in the file."""
    path = scratch_path(spark, "labelled")
    catalog(spark, d).table("customer").select(
        F.concat_ws(",", "c_mktsegment", "c_name", "c_custkey", F.concat(F.lit("alias "), "c_custkey"))
        .alias("c_mktsegment,Name,Number,Name")).write.option("header", True).option("sep", ";").csv(path)
    return map_headers(read_delimited(spark, path), LABELLED).select("c_custkey", "c_name", "c_alias", "c_mktsegment")
