"""Prefix trie of conversations by van Emde Boas recursion (operator 13).

A node of depth d is a distinct sequence of the first d turns of some sequence. The
trie of sequences of up to D turns is cut at half its depth: the upper half is a
trie of its own, and below every cut prefix hangs a lower one. Both are cut again,
down to single turns. All pieces of one size are worked on in one job, so there are
about log2(D) steps in place of D, and a conversation of very many turns is spread
over as many tasks as its turns need.

* *Down: names.* A turn is named by its digest. When two pieces are put together,
  each prefix that ends in the lower piece gets the digest of the cut prefix's name
  and its own. After the last step equal names are equal prefixes.
* *Up: totals.* Counts of leaves and sums of savings are known first for subtrees
  within single turns. When two pieces are put together, the totals of the lower
  piece's tops are summed at their cut prefix and grafted on to all nodes of the
  upper piece above it.

In both directions a cut prefix meets the ``2^k`` positions of one piece of one
sequence, dealt out in runs of ``RUN`` positions; hot prefixes are summed before
they move. A row leaves the recursion with the last step that can change it, so
short sequences take part in a few steps only. Each step is written to the shared
folder.

Defined results. Turns without a conversation id take no part; a null role or text
counts as empty; turns are ordered by their number, null first, and by digest where
they tie; repeated rows are turns of their own. An empty table has no nodes, a
sequence without turns belongs to the root. Names are 128 bits of SHA-256. Extra
columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ranking import POS, SIZE, positions
from tessera.llm.common import staged
from tessera.session import scratch_path

RUN = 4096          # positions of a sequence that are joined under one key
ENDS = 512          # ids in a row of the list of those that end at a node

NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string")


def digest(data: Column) -> Column:
    return F.substring(F.unhex(F.sha2(data, 256)), 1, 16)


def turns_in_order(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """``conv, pos`` (from 0), ``n`` (turns of the conversation), ``name`` and ``size``
    (code points) of every turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    named = rows.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.char_length(text).cast("long").alias("size"),
        digest(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("name"))
    placed = positions(named, ["conv"], [F.col("turn").asc_nulls_first(), F.col("name")])
    return placed.select("conv", F.col(POS).alias("pos"), F.col(SIZE).cast("long").alias("n"), "name", "size")


def with_borrowed_starts(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Sequences in which conversation c starts with the first h turns of
    ``c - c % every`` in place of its own, h being ``crc32(c) % most``. Returns the
    turns (``conv, pos, m, name, size``; m: turns of the sequence) and the sequences
    (``conv, m``)."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = turns.filter("pos = 0").select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    lengths = convs.select(F.col("conv").alias("base"), F.col("n").alias("lent"))
    seqs = (convs.join(lengths, "base", "left")
            .withColumn("lent", F.least("h", F.coalesce("lent", F.lit(0))))
            .withColumn("m", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    seqs = staged(seqs, "sequences")
    starts = (turns.filter((F.col("conv") % every == 0) & (F.col("pos") < most - 1))
              .select(F.col("conv").alias("base"), "pos", "name", "size"))
    borrowed = (seqs.join(starts, "base").filter(F.col("pos") < F.col("h"))
                .select("conv", "pos", "m", "name", "size"))
    runs = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / RUN))).alias("run")
    own = (turns.withColumn("run", F.floor(F.col("pos") / RUN)).drop("n")
           .join(seqs.select("conv", "h", "lent", "m", runs), ["conv", "run"])
           .filter(F.col("pos") >= F.col("h"))
           .select("conv", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "m", "name", "size"))
    return borrowed.unionByName(own), seqs.select("conv", "m")


# --------------------------------------------------------------------- names

def in_lower(k: int) -> Column:
    """Does the position lie in the lower half of its piece of ``2^k`` turns?"""
    return F.shiftright("pos", k - 1).bitwiseAND(F.lit(1)) == 1


def run_of(pos: Column) -> Column:
    return F.floor(pos / RUN)


def runs(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(run_of(first), run_of(last))).alias("run")


def named(turns: DataFrame, depth: int) -> DataFrame:
    """``turns`` with the name of the whole prefix that ends there."""
    spark, root = turns.sparkSession, scratch_path(turns.sparkSession, "names")
    turns.write.parquet(f"{root}/level=0")
    schema = turns.schema
    for k in range(1, depth.bit_length() + 1):
        half = 1 << (k - 1)
        live = spark.read.schema(schema).parquet(f"{root}/level={k - 1}").filter(F.col("pos") >= half - 1)
        ends = live.filter(~in_lower(k) & ((F.col("pos") + 1) % half == 0) & (F.col("m") > F.col("pos") + 1))
        cuts = ends.select("conv", F.shiftright(F.col("pos") + 1, k - 1).alias("piece"), F.col("name").alias("cut"),
                           runs(F.col("pos") + 1, F.least(F.col("pos") + half, F.col("m") - 1)))
        lower = (live.filter(in_lower(k)).withColumn("piece", F.shiftright("pos", k - 1)).withColumn("run", run_of(F.col("pos")))
                 .join(cuts, ["conv", "piece", "run"]).withColumn("name", digest(F.concat("cut", "name"))))
        live.filter(~in_lower(k)).unionByName(lower.select(*live.columns)).write.parquet(f"{root}/level={k}")
    last = F.length(F.bin(F.col("pos") + 1))        # the step after which nothing changes a row
    return spark.read.parquet(root).filter(F.col("level") == last).drop("level")


# -------------------------------------------------------------------- totals

def with_totals(nodes: DataFrame, prefixes: DataFrame, depth: int) -> DataFrame:
    """``name, leaves, saved``: sums of the nodes' ``leaves`` and ``saved`` over their
    subtrees. Nodes have ``name, pos, parent, conv`` (one of their members) and
    ``deepest`` (turns of their longest member)."""
    spark, root = nodes.sparkSession, scratch_path(nodes.sparkSession, "totals")
    pos, steps = F.col("pos"), depth.bit_length()
    gains = [F.when(~in_lower(k) & (F.shiftleft(F.shiftright("pos", k - 1) + 1, k - 1) < F.col("deepest")), k).otherwise(0)
             for k in range(1, steps + 1)]
    gives = F.when(pos > 0, F.length(F.regexp_extract(F.bin(pos), "0*$", 0)) + 1).otherwise(0)
    nodes = nodes.withColumn("last", F.greatest(F.lit(0), *gains, gives)).drop("deepest")
    nodes.write.parquet(f"{root}/level=0")
    for k in range(1, steps + 1):
        half = 1 << (k - 1)
        live = spark.read.schema(nodes.schema).parquet(f"{root}/level={k - 1}").filter(F.col("last") >= k)
        first = F.shiftleft(F.col("piece"), k - 1)
        grafts = (live.filter(in_lower(k) & (pos % half == 0)).groupBy("parent")
                  .agg(F.min("conv").alias("conv"), F.min(F.shiftright("pos", k - 1) - 1).alias("piece"),
                       F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
                  .select("conv", "piece", "more_leaves", "more_saved", runs(first, first + half - 1)))
        above = (prefixes.filter(~in_lower(k) & (F.shiftleft(F.shiftright("pos", k - 1) + 1, k - 1) < F.col("m")))
                 .select("conv", "name", F.shiftright("pos", k - 1).alias("piece"), run_of(pos).alias("run")))
        more = (above.join(grafts, ["conv", "piece", "run"]).groupBy("name")
                .agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved")))
        plus = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)     # noqa: E731
        (live.join(more, "name", "left").select(*[plus(c) if c in ("leaves", "saved") else c for c in live.columns])
         .write.parquet(f"{root}/level={k}"))
    return spark.read.parquet(root).filter(F.col("level") == F.col("last")).drop("level", "last")


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """``name`` and the SHA-256 of the ascending, comma-joined ids in ``conv``. Ids are
    first joined in rows of a bounded range of ids; a task then takes the rows of its
    names in order and holds one batch of them."""
    lists = (ends.groupBy("name", F.floor(F.col("conv") / ENDS).alias("part"))
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, None
        for b in batches:
            out = []
            for n, ids in zip(b["name"], b["ids"]):
                if n == name:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    out.append((name, state.hexdigest()))
                name, state = n, hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["name", "ends_sha256"])
        if state:
            yield pd.DataFrame([(name, state.hexdigest())], columns=["name", "ends_sha256"])

    return lists.repartition("name").sortWithinPartitions("name", "part").mapInPandas(hashed, "name binary, ends_sha256 string")


# ---------------------------------------------------------------------- trie

def trie(turns: DataFrame, seqs: DataFrame) -> DataFrame:
    """All nodes of the sequences ``seqs`` (``conv, m``) with turns ``conv, pos, m, name,
    size``: the smallest member, depth, the parent's smallest member, numbers of
    members, children and leaves, the savings, and the digest of those that end there."""
    spark = turns.sparkSession
    n, first, depth = seqs.agg(F.count("*"), F.min("conv"), F.max("m")).first()
    if not n:
        return spark.createDataFrame([], NODES)
    prefixes = named(turns, depth)
    nodes = staged(prefixes.groupBy("name", "pos").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("m").alias("deepest"), F.min("size").alias("size")), "nodes")
    above = prefixes.select("conv", (F.col("pos") + 1).alias("pos"), F.col("name").alias("parent"))
    nodes = staged(nodes.join(above, ["conv", "pos"], "left"), "nodes")
    below = nodes.groupBy("parent").agg(F.count("*").alias("n_children"))
    nodes = staged(nodes.join(below.withColumnRenamed("parent", "name"), "name", "left")
                   .withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    totals = with_totals(nodes.select(
        "name", "pos", "parent", "conv", "deepest", (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved")), prefixes, depth)
    ends = prefixes.filter(F.col("pos") == F.col("m") - 1).select("name", "conv")
    empty = F.lit(b"").alias("name")
    ends = staged(digests_of_ends(ends.unionByName(seqs.filter("m = 0").select(empty, "conv"))), "ends")
    nobody = hashlib.sha256(b"").hexdigest()
    tops = nodes.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"))
    totals = totals.select("name", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "pos")
    totals = staged(totals, "totals")
    inner = (nodes.drop("deepest", "size").join(totals.drop("pos"), "name").join(ends, "name", "left").join(tops, "parent", "left")
             .select(F.col("conv").alias("conv_id"), (F.col("pos") + 1).alias("depth"),
                     F.when(F.col("pos") == 0, F.lit(first)).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
                     "n_convs", "n_children", "n_leaves", "saved_tokens",
                     F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256")))
    children, leaves, saved = totals.filter("pos = 0").agg(F.count("*"), F.sum("n_leaves"), F.sum("saved_tokens")).first()
    at_root = ends.filter(F.length("name") == 0).first()
    top = spark.createDataFrame([(first, 0, None, n, children, leaves or 1, saved or 0,
                                  at_root["ends_sha256"] if at_root else nobody)], NODES)
    return inner.unionByName(top)
