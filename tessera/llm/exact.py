"""Exact dedup by content-defined chunk recipes (operator 5, Spark functions only).

1. Every normalised text is cut into chunks where its content says so: a chunk
   ends at white space before one of a few letters, no sooner than
   ``MIN_CHUNK`` and no later than ``MAX_CHUNK`` characters. Equal texts cut
   alike, wherever they lie.
2. Every *distinct* chunk is moved once (partial aggregation drops repeats
   before the shuffle) to verify its identifier: a hash that two different
   chunks share is told apart by an ordinal.
3. A document is its ordered list of verified identifiers, 8 bytes for some
   hundred characters. Only these recipes are grouped, joined and moved, never
   a long text again. Equal recipes are equal texts, so nothing rests on a
   hash being free of collisions.

A hot group (one text in a third of all rows) is folded by partial aggregation
before the shuffle; in the join back to the documents its rows are salted.

Defined results. Null text counts as empty; empty texts are one group. A null
id never wins over an id; in a group of null ids only, ``keep_id`` is null and
all rows stay. Repeated rows (equal id and text) all point to that id.
``dedup`` leaves one of them. Extra columns are ignored here and untouched by
``dedup``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, prefix, staged

MIN_CHUNK, MAX_CHUNK = 256, 4096
SALTS = 16
CUT = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?\s(?=[b-d])|.{{1,{MAX_CHUNK}}}"


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (docs.select(F.col(id_col).alias("id"), ascii_lower(text).alias("norm"))
            .withColumn("chunks", F.regexp_extract_all("norm", F.lit(CUT), F.lit(0))))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(id, text_sha256, recipe): the ordered verified chunk identifiers."""
    prepared = _prepared(docs, id_col, text_col)
    plain = staged(prepared.select(
        "id", F.sha2("norm", 256).alias("text_sha256"),
        F.transform("chunks", lambda c: chunk_hash(c)).alias("recipe")), "recipes")
    distinct_chunks = (prepared.select(F.explode("chunks").alias("chunk"))
                       .select(chunk_hash(F.col("chunk")).alias("hash"), "chunk").distinct())
    shared = staged(distinct_chunks.groupBy("hash").agg(
        F.count("*").alias("n")).filter("n > 1").select("hash"), "shared-hashes")
    if shared.isEmpty():
        return plain
    # Different chunks share a hash: number them, and write (hash, number) for each.
    numbered = staged(distinct_chunks.join(shared, "hash", "left_semi").withColumn(
        "number", F.row_number().over(Window.partitionBy("hash").orderBy("chunk"))), "shared-chunks")
    rows = prepared.withColumn("row", F.monotonically_increasing_id())
    rows = staged(rows.select("row", "id", F.sha2("norm", 256).alias("text_sha256"), "chunks"), "clashing")
    ids = (rows.select("row", F.posexplode("chunks").alias("pos", "chunk"))
           .withColumn("hash", chunk_hash(F.col("chunk")))
           .join(numbered, ["hash", "chunk"], "left")
           .groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
               "pos", F.concat_ws("/", F.col("hash").cast("string"),
                                  F.coalesce("number", F.lit(0)).cast("string")).alias("chunk_id"))))
               .alias("ids")))
    return rows.drop("chunks").join(ids, "row", "left").select(
        "id", "text_sha256", F.coalesce(F.col("ids.chunk_id"), F.array().cast("array<string>")).alias("recipe"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: ``id_col``, keep_id, group_size, kept, text_sha256."""
    rows = recipes(docs, id_col, text_col, chunk_hash)
    groups = (rows.groupBy("recipe")
              .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
              .filter("group_size > 1"))
    # Salted: a hot recipe is spread over SALTS tasks, each with its own copy of the group's row.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = salted.join(groups, ["recipe", "salt"], "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True))
         .otherwise(F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the largest
    id; of rows that repeat id and text, one."""
    out = exact_duplicates(docs, id_col, text_col)
    # Only rows to drop and repeated rows, one each; partial aggregation folds hot groups.
    p = prefix(docs)
    verdict = (out.groupBy(F.col(id_col).alias(p + "id"), F.col("text_sha256").alias(p + "sha"))
               .agg(F.first("kept").alias(p + "kept"), F.count("*").alias(p + "rows"))
               .filter(f"not {p}kept or {p}rows > 1"))
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)
    judged = docs.withColumn(p + "own", sha).join(
        verdict, F.col(id_col).eqNullSafe(F.col(p + "id")) & (F.col(p + "own") == F.col(p + "sha")), "left")
    once = judged.filter(f"{p}rows is null")
    repeated = judged.filter(p + "kept").dropDuplicates([id_col, p + "own"])
    return once.unionByName(repeated).select(*docs.columns)
