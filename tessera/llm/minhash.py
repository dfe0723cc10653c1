"""MinHash near-dedup (operator 2).

1. Each text becomes its set of distinct word shingles (64-bit hashes). Rows
   with equal sets are one *node*, so exact copies never meet again before the
   last step, however many there are.
2. Each node has ``BANDS x ROWS`` universal hash minima. Nodes that agree in
   all rows of a band share a bucket. At similarity 0.8 a pair shares none of
   the buckets with probability (1 - 0.8^ROWS)^BANDS.
3. Round one links every node with one leader of each of its buckets. A pair
   passes when enough of its minima agree (signature verification; at 0.8 a
   pair fails this with a probability below 1e-7) and then, exactly, when
   100 * |a and b| >= threshold * |a or b| on the full sets.
4. Components are found by alternating large-star and small-star. Buckets whose
   nodes are all in one component are settled: no further link can change the
   result. In the others, nodes are paired along random orders, which joins up
   large groups of near copies at the cost of their size; then each pair left
   across components is verified. Pairs too unlike in set size, or in one
   bit of each minimum, are not made at all.
5. In buckets of more than LARGE nodes not all pairs are made. Each node is held
   against a hub, the node whose own large buckets hold most, and its difference is
   what one of the two sets lacks. Two nodes that are both similar to the hub
   are linked already; of two others that are similar, at least one is not, so
   their differences have much in common (``_differences``). They share one of the
   first shingles of both, rarest first (prefix filter), and only nodes that do are
   paired. Nothing is lost: the bounds hold for every pair that reaches the threshold.

Texts are moved once, by row, to build the sets of nodes that have a candidate.
Buckets and nodes are joined between exchanges that adaptive execution splits.

Defined results. Null texts and texts without words have the empty set, are
linked with nothing and are their own component. Rows that repeat an id and a
text are linked like any equal texts and all stay kept if theirs is the
smallest id; ``dedup`` leaves one of them. A null id never names a component:
its ``component_id`` is the smallest id of its group, or null. Extra columns
are ignored by ``near_duplicates`` and kept by ``dedup``. Empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import prefix, staged
from tessera.llm.graph import connected_components

WORDS = 5
THRESHOLD = 80              # hundredths
BANDS, ROWS = 40, 5
AGREE = 0.2                 # a pair may fall this far below the threshold by its signature
EASY = 4                    # random chains go on while more pairs an entry are left, and each round halves them
LARGE = 32                  # nodes of a bucket from which pairs are made by their differences from a hub
CLOSE = 30                  # BITS of a chain's pairs: these only speed up what follows
CHAIN = 256                 # nodes of a bucket that one task orders, about
BITS = 46                   # of BANDS * ROWS low bits, this many may differ: at 0.8, 20 do, more than 46 in 1e-8 of pairs
SLICE = 1 << 13             # shingles hashed at a time
MEMO = 1 << 20
_rnd = np.random.default_rng(20240229)
MULTIPLY = _rnd.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * 2 + 1
ADD = _rnd.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]   # of well-known 64-bit mixers


class Words(dict):
    """Word to 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(ODD[1])
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, memo: Words, k: int) -> np.ndarray:
    """Sorted distinct shingles of ``k`` words; of fewer words, all as one."""
    words = text.encode("utf-8", "replace").lower().split() if text else []   # splits at 20 and 09-0D, lowers A-Z
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = mixed(out * np.uint64(ODD[0]) + h[j:len(h) - n + 1 + j])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """The minima of all universal hashes a * x + b (upper half of 64 bits) of 32-bit x."""
    x, low = s >> np.uint64(32), None
    for at in range(0, len(x), SLICE):
        part = (MULTIPLY[:, None] * x[None, at:at + SLICE] + ADD[:, None]).min(axis=1)
        low = part if low is None else np.minimum(low, part)
    return (low >> np.uint64(32)).astype(np.uint32)


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        out = mixed(out * np.uint64(ODD[2]) + column)
    return out.view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """The lowest bit of each minimum, as four longs."""
    bits = np.packbits((sig & 1).astype(np.uint8))
    return np.concatenate((bits, np.zeros(32 - len(bits), np.uint8))).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= threshold * (len(a) + len(b) - common)


def _rows(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Per row: id, text key, number of shingles, key of the set, buckets."""
    key_type = docs.schema[id_col].dataType.simpleString()

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Words()
        with np.errstate(over="ignore"):
            for b in batches:
                sets = [shingles(t, memo, k) for t in b["text"]]
                sigs = [signature(s) if len(s) else None for s in sets]
                yield pd.DataFrame({
                    "id": b["id"].array, "text_key": b["text_key"], "n": [len(s) for s in sets],
                    "set_key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                    "buckets": [None if s is None else bands(s) for s in sigs],
                    "sketch": [None if s is None else sketch(s) for s in sigs]})

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInPandas(build, f"id {key_type}, text_key long, n long, set_key binary, buckets array<long>, "
                                 "sketch array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(node, sig, shingles) of the wanted nodes, from one row's text each."""
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Words()
        with np.errstate(over="ignore"):
            for b in batches:
                sets = [shingles(t, memo, k) for t in b["text"]]
                yield pd.DataFrame({"node": b["node"], "sig": [signature(s).tobytes() for s in sets],
                                    "shingles": [s.tobytes() for s in sets]})

    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("text"))
    one = wanted.select("node", "rep_id", "text_key")
    found = rows.join(one, F.col("_id").eqNullSafe(F.col("rep_id")) & (F.col("_key") == F.col("text_key")))
    return found.select("node", "text").mapInPandas(build, "node long, sig binary, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (u, v) that are similar: by signature first, then on full sets."""
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least = (threshold / 100 - AGREE) * BANDS * ROWS
        for b in batches:
            keep = []
            for sa, sb, a, c in zip(b["sig_u"], b["sig_v"], b["set_u"], b["set_v"]):
                agree = (np.frombuffer(sa, np.uint32) == np.frombuffer(sb, np.uint32)).sum()
                keep.append(agree >= least and similar(np.frombuffer(a, np.uint64), np.frombuffer(c, np.uint64), threshold))
            yield b.loc[keep, ["u", "v"]]

    def side(x: str) -> DataFrame:
        return sets.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("shingles").alias(f"set_{x}"))

    return pairs.join(side("v"), "v").join(side("u"), "u").mapInPandas(check, "u long, v long").distinct()


def _hubs(entries: DataFrame) -> DataFrame:
    """(u, v): for the nodes v of each bucket (bucket, v, size), the hub u of the
    bucket: of its node with the fullest buckets, the fullest neighbour."""
    score = F.sum("size").over(Window.partitionBy("v")).alias("score")
    scored = staged(entries.select("bucket", "v", score), "minhash-scores")
    first = scored.groupBy("bucket").agg(F.max(F.struct("score", "v")).alias("first"))
    best = scored.join(first, "bucket").groupBy("v").agg(F.max("first").alias("best"))
    hub = first.select("bucket", F.col("first.v").alias("v")).join(best, "v").select("bucket", F.col("best.v").alias("u"))
    return scored.join(hub, "bucket").filter("u <> v").select("u", "v").distinct()


def _differences(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Per hub u and node v: ``apart``, the shingles that one of the two lacks, whether
    the two are similar, and in how many of ``apart``, rarest first, v meets another node.

    With d(x) shingles apart, n(x) in its set and c = (100 - threshold) / (100 + threshold),
    x is similar to the hub when d(x) <= c * (n(x) + n(u)), and to y when the two
    differences share (d(x) + d(y) - c * (n(x) + n(y))) / 2 or more. ``half`` holds
    towards any y that is not similar to u, ``far`` for such a y towards any x."""
    less, more = 100 - threshold, 100 + threshold

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for u, v, a, c in zip(b["u"], b["v"], b["set_u"], b["set_v"]):
                a, c = np.frombuffer(a, np.uint64), np.frombuffer(c, np.uint64)
                apart = np.setxor1d(a, c, assume_unique=True)
                d, n, m = len(apart), len(c), len(a)
                half = max(1, -(-(more * d + less * (m - n)) // (2 * more)))
                far = max(1, d - less * n // threshold)
                out.append((u, v, n, d, less * (n + m) >= more * d, d - half + 1, d - far + 1, apart.view(np.int64)))
            yield pd.DataFrame(out, columns=["u", "v", "n", "d", "linked", "half", "far", "apart"])

    def side(x: str) -> DataFrame:
        return sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))

    return pairs.join(side("v"), "v").join(side("u"), "u").mapInPandas(
        build, "u long, v long, n long, d long, linked boolean, half long, far long, apart array<long>")


def _meetings(nodes: DataFrame, threshold: int, alike: Column) -> DataFrame:
    """Pairs (u, v) of ``nodes``, rows of ``_differences`` with their sketch and root,
    whose differences may have enough in common."""
    each = nodes.select("u", "v", "half", "far", "linked", F.explode("apart").alias("e"))
    often = each.groupBy("u", "e").agg(F.count("*").alias("f")).filter("f > 1")
    rarest = Window.partitionBy("u", "v").orderBy(F.coalesce("f", F.lit(1)), "e")
    reach = F.when(F.col("linked"), F.col("half")).otherwise(F.greatest("half", "far"))
    firsts = (each.join(often, ["u", "e"], "left").withColumn("at", F.row_number().over(rarest))
              .filter(F.col("f").isNotNull() & (F.col("at") <= reach)).select("u", "v", "e", "at"))
    firsts = staged(firsts.join(nodes.drop("apart"), ["u", "v"]), "minhash-firsts")
    one = firsts.filter("at <= half").select("u", "e", *[F.col(c).alias(f"u_{c}") for c in (
        "v", "at", "n", "d", "linked", "sketch", "root")])
    two = firsts.filter("not linked").select(F.col("u").alias("b_u"), F.col("e").alias("b_e"), *[
        c for c in firsts.columns if c not in ("u", "e", "linked")])
    once = F.expr("u_linked and at <= far or not u_linked and u_v < v and at <= half")
    # The first shingle that a pair shares leaves room for enough others.
    room = F.expr(f"{2 * (100 + threshold)} * (1 + least(u_d - u_at, d - at)) >= "
                  f"{100 + threshold} * (u_d + d) - {100 - threshold} * (u_n + n)")
    return one.join(two, (F.col("u") == F.col("b_u")) & (F.col("e") == F.col("b_e")) & once & room & alike).select(
        F.least("u_v", "v").alias("u"), F.greatest("u_v", "v").alias("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id, kept."""
    return _judged(docs, id_col, text_col, words, threshold).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def _judged(docs: DataFrame, id_col: str, text_col: str, words: int, threshold: int) -> DataFrame:
    """id, text_key, n, component_id and kept of every row."""
    rows = staged(_rows(docs, id_col, text_col, words), "minhash-rows")
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("rep")
    nodes = staged(rows.filter("n > 0").groupBy("set_key").agg(rep, *[F.first(c).alias(c) for c in ("n", "buckets", "sketch")])
                   .select("set_key", F.col("rep.id").alias("rep_id"), F.col("rep.text_key").alias("text_key"), "n",
                           "buckets", "sketch", F.monotonically_increasing_id().alias("node")), "minhash-nodes")
    entries = nodes.select("node", F.explode("buckets").alias("bucket"))
    # Round one: buckets of two nodes or more, and a star in each.
    leaders = staged(entries.groupBy("bucket").agg(F.min("node").alias("u"), F.count("*").alias("n"))
                     .filter("n > 1").drop("n"), "minhash-leaders")
    shared = staged(entries.withColumnRenamed("node", "v").join(leaders, "bucket"), "minhash-shared")
    stars = staged(shared.filter("u <> v").select("u", "v").distinct(), "minhash-stars")
    ends = stars.select(F.col("u").alias("node")).union(stars.select("v")).distinct()
    sets = staged(_sets(docs, nodes.join(ends, "node"), id_col, text_col, words), "minhash-sets")
    links = staged(_verified(stars, sets, threshold), "minhash-links")
    roots = staged(connected_components(links), "minhash-roots")
    marks = nodes.select(F.col("node").alias("v"), "n", "sketch", "buckets")

    def open_entries() -> tuple[DataFrame, int, int]:
        """Entries of the buckets that more than one component meets in, how
        many they are, and how many pairs across components they make."""
        placed = shared.join(roots.withColumnRenamed("node", "v"), "v", "left").select(
            "bucket", "v", F.coalesce("root", "v").alias("root"))
        many = placed.groupBy("bucket", "root").agg(F.count("*").alias("m")).groupBy("bucket").agg(
            F.count("*").alias("roots"), F.sum("m").alias("size"), F.sum(F.col("m") * F.col("m")).alias("same"))
        many = staged(many.filter("roots > 1").select("bucket", "size", "same"), "minhash-many")
        n, pairs = many.agg(F.sum("size"), F.sum((F.col("size") * F.col("size") - F.col("same")) / 2)).first()
        return staged(placed.join(many.select("bucket", "size"), "bucket"), "minhash-entries"), n or 0, int(pairs or 0)

    def alike(a: str, b: str, bits: int = BITS) -> Column:
        """What every pair that reaches the threshold fulfils."""
        n, m = F.col(f"{a}n"), F.col(f"{b}n")
        apart = sum((F.bit_count(F.col(f"{a}sketch")[i].bitwiseXOR(F.col(f"{b}sketch")[i])) for i in range(4)), F.lit(0))
        return ((100 * F.least(n, m) >= threshold * F.greatest(n, m)) & (apart <= bits)
                & (F.col(f"{a}root") != F.col(f"{b}root")))

    def joined(pairs: DataFrame) -> bool:
        """Whether any of the pairs is a link; if so, the components grow."""
        return grown_by(staged(_verified(pairs.distinct(), sets, threshold), "minhash-more"))

    def grown_by(more: DataFrame) -> bool:
        nonlocal roots
        if more.isEmpty():
            return False
        # Only what the new links join up: components of components.
        to = roots.select(F.col("node").alias("u"), "root")
        tv = roots.select(F.col("node").alias("v"), F.col("root").alias("root_v"))
        up = more.join(to, "u", "left").join(tv, "v", "left").select(
            F.coalesce("root", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
        grown = staged(connected_components(up), "minhash-grown")
        moved = grown.select(F.col("node").alias("root"), F.col("root").alias("new"))
        roots = staged(roots.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
                       .unionByName(grown.join(roots.select("node"), "node", "left_anti")), "minhash-roots")
        return True

    turn = 0
    entries, n, left = open_entries()
    large = entries.filter(F.col("size") > LARGE)
    hubs = left > 0 and not large.isEmpty()
    if hubs:
        differences = staged(_differences(_hubs(large), sets, threshold), "minhash-differences")
        if grown_by(differences.filter("linked").select("u", "v")):
            entries, n, left = open_entries()
    while left > EASY * n:
        chained = entries.join(marks.drop("buckets"), "v").withColumn("order", F.xxhash64("v", F.lit(turn))).withColumn(
            "part", F.pmod(F.xxhash64("order"), 1 + F.floor(F.col("size") / F.lit(CHAIN))))
        along = Window.partitionBy("bucket", "part").orderBy("order", "v")
        last = F.lag(F.struct("v", "root", "n", "sketch")).over(along)
        pairs = (chained.select("v", "root", "n", "sketch", last.alias("p"))
                 .filter(F.col("p").isNotNull() & alike("p.", "", CLOSE)).select(F.col("p.v").alias("u"), "v"))
        turn, before = turn + 1, left
        if not joined(pairs):
            break
        entries, n, left = open_entries()
        if 2 * left > before:       # what is left are pairs that hardly ever link
            break
    if left:
        if hubs:
            open_ = entries.filter(F.col("size") > LARGE).select("v", "root").distinct()
            open_ = open_.join(marks.select("v", "sketch"), "v")
            pairs = _meetings(staged(differences.join(open_, "v"), "minhash-apart"), threshold, alike("u_", ""))
            if joined(pairs):
                entries, n, left = open_entries()
        right = staged(entries.filter(F.col("size") <= LARGE).drop("size").join(marks, "v"), "minhash-open")
        one = right.select("bucket", *[F.col(c).alias(f"u_{c}") for c in ("v", "root", "n", "sketch", "buckets")])
        # A pair is made in the first bucket that it shares, and in no other.
        here = F.col("b_bucket") == F.array_min(F.array_intersect("u_buckets", "buckets"))
        two = right.withColumnRenamed("bucket", "b_bucket")
        joined(one.join(two, (F.col("bucket") == F.col("b_bucket")) & (F.col("u_v") < F.col("v")) & alike("u_", "") & here)
               .select(F.col("u_v").alias("u"), "v"))
    # Back to the documents: the smallest id of each component.
    placed = nodes.select("set_key", "node", "rep_id").join(roots, "node", "left").select(
        "set_key", "rep_id", F.coalesce("root", "node").alias("root"))
    smallest = staged(placed.groupBy("root").agg(F.min("rep_id").alias("component_id")), "minhash-smallest")
    named = staged(placed.join(smallest, "root").select("set_key", "component_id"), "minhash-named")
    out = rows.join(named, "set_key", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "text_key", "n", component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
          threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near copies, the one
    with the smallest id; of rows that repeat it, one."""
    out = _judged(docs, id_col, text_col, words, threshold)
    # Only rows to drop and repeated rows, one each; partial aggregation folds hot groups.
    p = prefix(docs)
    verdict = (out.groupBy(F.col("id").alias(p + "id"), F.col("text_key").alias(p + "key"))
               .agg(F.first("kept").alias(p + "kept"), F.count("*").alias(p + "rows"))
               .filter(f"not {p}kept or {p}rows > 1"))
    judged = docs.withColumn(p + "own", F.xxhash64(text_col)).join(
        verdict, F.col(id_col).eqNullSafe(F.col(p + "id")) & (F.col(p + "own") == F.col(p + "key")), "left")
    once = judged.filter(f"{p}rows is null")
    repeated = judged.filter(p + "kept").dropDuplicates([id_col, text_col])
    return once.unionByName(repeated).select(*docs.columns)
