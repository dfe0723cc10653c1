"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged

SALTS = 8


def _with_min(rows: DataFrame, mins: DataFrame) -> DataFrame:
    """``rows`` (u, v) with the ``m`` of their u. A node with very many edges is
    salted over SALTS tasks; its minimum is one row, copied to each."""
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS))
    copies = mins.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", salt).join(copies, ["u", "salt"]).drop("salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the long pairs (u, v); root is the
    smallest node that can be reached. Every round is written to the shared
    folder. It ends when the edges are stars: every node that points to a smaller
    one points to that one only, and nothing points to it."""
    now = staged(edges.select("u", "v").filter("u <> v").distinct(), "cc")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = staged(_with_min(both.filter("v > u"), mins).select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .distinct(), "cc-large")
        mins = large.groupBy("u").agg(F.min("v").alias("m"))       # here u > v in every row
        small = _with_min(large, mins).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(small.unionByName(mins.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
            now.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter(
                (F.col("out") > 1) | (F.col("out") == 1) & (F.col("into") == 1)).isEmpty():
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.unionByName(now.select(F.col("u").alias("node"), F.col("v").alias("root")))
