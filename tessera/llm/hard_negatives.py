"""Hard-negative mining by segment summary filtering (operator 11).

An anchor's positives are its best rows of the same label; for every positive, the
best rows of other labels whose score lies between two percentages of the
positive's score are its hard negatives. A score is the inner product of vectors
whose components are ``floor(scale * x)``, ties go to the smaller id.

1. *Summaries.* Every row is stored once with the mean and deviation of each
   segment of ``SEGMENT`` components. With ``l`` components a segment, the score
   lies within the sum of ``l * mean * mean'`` plus or minus the sum of
   ``l * deviation * deviation'``. Summaries of longer segments follow from those
   of their parts, so one segment for the whole vector, then ``FAN`` times as many,
   down to the stored ones bound a score ever more closely.
2. *Filter.* Anchors are taken in groups whose size in bytes is bounded and sent to
   all tasks, which run over the rows where they lie. Pairs whose bounds rule them
   out go, level by level, and only those left are scored exactly.
3. *Rounds.* Rows are dealt by hash to rounds, each ``GROWTH`` times as large as the
   one before. What a round has found is a proven limit for the next, so a task
   returns, beyond the first rows, about ``GROWTH`` times what stays in the end
   however large the table is. No row is left out: the rounds together are the table.

Every round and group is written to the shared folder, so a lost executor costs the
tasks it ran. The driver holds one group of anchors at a time.

Defined results. Rows with a null id, label or vector, or with a null or non-finite
component, take no part. Repeated rows count once; rows that share an id but differ
are rows of their own, but never each other's positive or negative. A shorter vector
counts as followed by zeros, an empty one as zeros. Scores beyond the range of long
are cut off at its ends. No anchors, or an empty table, give an empty result. Extra
columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged
from tessera.session import scratch_path

SEGMENT = 2                 # components of the shortest segments
FAN = 4                     # parts into which a segment is refined
GROUP_BYTES = 16 << 20      # of anchors that are sent to the tasks at once
FIRST_ROWS = 4096           # rows of the first round, about
GROWTH = 16                 # how much larger each round is than the one before
TILE = 1024, 2048           # anchors and rows whose bounds are in memory at once
EXACT = 2.0 ** 53           # sums of doubles below this are exact integers
LONG = 2 ** 63 - 1

ROWS = "id long, label string, q binary, wide binary, mean binary, dev binary"
FOUND = "a int, w int, id long, score long"


# ---------------------------------------------------------------- summaries

def summary(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment of each row."""
    parts = q.reshape(len(q), -1, SEGMENT)
    return parts.mean(2), parts.std(2)


def levels(mean: np.ndarray, dev: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """From one segment for all to the stored ones: means and deviations, each times
    the root of the segment's length, so that plain products of two rows bound them."""
    out, length = [], SEGMENT
    while True:
        out.append((mean * math.sqrt(length), dev * math.sqrt(length)))
        if mean.shape[1] == 1:
            return out[::-1]
        fan = min(FAN, mean.shape[1])
        m, d = (x.reshape(len(x), -1, fan) for x in (mean, dev))
        mean = m.mean(2)
        dev = np.sqrt(np.maximum((d * d + m * m).mean(2) - mean * mean, 0))
        length *= fan


def width(dims: int) -> int:
    """Components with padding: as many segments as a power of two."""
    return SEGMENT << max(0, math.ceil(dims / SEGMENT) - 1).bit_length()


def stored(batches: Iterator[pd.DataFrame], scale: float) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for v in b["vec"]:
            q = np.floor(scale * np.asarray(v, float))
            if len(q) and np.abs(q).max() >= 2 ** 31:
                out.append((None, q.tobytes(), None, None))
                continue
            m, d = summary(np.pad(q, (0, -len(q) % SEGMENT))[None])
            out.append((q.astype(np.int32).tobytes(), None, m.astype(np.float32).tobytes(), d.astype(np.float32).tobytes()))
        yield pd.DataFrame(out, columns=["q", "wide", "mean", "dev"]).assign(id=b["id"].array, label=b["label"].array)[
            ["id", "label", "q", "wide", "mean", "dev"]]


def unpacked(values: list[bytes], dtype, columns: int) -> np.ndarray:
    """Rows of equal or unequal length, followed by zeros."""
    size = np.dtype(dtype).itemsize * columns
    return np.frombuffer(b"".join([v.ljust(size, b"\0") for v in values]), dtype).reshape(len(values), columns).astype(float)


def loaded(b: pd.DataFrame, columns: int) -> tuple:
    """(ids, labels, vectors, means, deviations) of a batch of stored rows."""
    empty = lambda x: [v if v is not None else b"" for v in x]      # noqa: E731
    q = unpacked(empty(b["q"]), np.int32, columns)
    mean, dev = (unpacked(empty(b[c]), np.float32, columns // SEGMENT) for c in ("mean", "dev"))
    wide = np.flatnonzero(b["wide"].notna())
    if len(wide):
        q[wide] = unpacked([b["wide"].iloc[k] for k in wide], np.float64, columns)
        mean[wide], dev[wide] = summary(q[wide])
    return b["id"].to_numpy(np.int64), b["label"].to_numpy(object), q, mean, dev


# ------------------------------------------------------------------- filter

def exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Scores of the pairs ``x[i], y[j]`` as longs."""
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * x.shape[1] < EXACT:
        if 8 * len(i) > len(x) * len(y):
            return (x @ y.T)[i, j].astype(np.int64)
        cuts = range(0, len(i), 1 << 16)
        return np.concatenate([np.einsum("ij,ij->i", x[i[c:c + (1 << 16)]], y[j[c:c + (1 << 16)]]) for c in cuts]
                              or [np.zeros(0)]).astype(np.int64)
    dots = [sum(int(a) * int(b) for a, b in zip(x[s], y[t])) for s, t in zip(i, j)]
    return np.array([min(max(d, -LONG), LONG) for d in dots], np.int64)


def survivors(anchors, rows, alike: bool, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of (anchor, row), labels equal or unequal as ``alike`` says, that may
    score between ``low`` and ``high`` of their anchor."""
    codes = pd.factorize(np.concatenate([anchors["label"], rows["label"]]))[0]
    left, right = codes[:len(anchors["label"])], codes[len(anchors["label"]):]
    mask = ((left[:, None] == right) == alike) & (anchors["id"][:, None] != rows["id"])
    pairs = None
    for (ma, da), (mr, dr) in zip(anchors["levels"], rows["levels"]):
        slack = 1 + 1e-5 * math.sqrt(((ma ** 2 + da ** 2).sum(1).max() * (mr ** 2 + dr ** 2).sum(1).max()))
        if pairs is None and 8 * np.count_nonzero(mask) < mask.size:
            pairs = np.nonzero(mask)
        if pairs is None:
            mid, off = ma @ mr.T, da @ dr.T + slack
            mask &= (mid + off >= low[:, None]) & (mid - off <= high[:, None])
        else:
            keep = []
            for c in range(0, len(pairs[0]), 1 << 16):
                i, j = (p[c:c + (1 << 16)] for p in pairs)
                mid = np.einsum("ij,ij->i", ma[i], mr[j])
                off = np.einsum("ij,ij->i", da[i], dr[j]) + slack
                keep.append((mid + off >= low[i]) & (mid - off <= high[i]))
            keep = np.concatenate(keep or [np.zeros(0, bool)])
            pairs = pairs[0][keep], pairs[1][keep]
    return pairs if pairs is not None else np.nonzero(mask)


def top(a, w, ids, scores, k: int):
    """The best ``k`` of each (anchor, window), repeated rows once."""
    order = np.lexsort((ids, -scores, w, a))
    a, w, ids, scores = a[order], w[order], ids[order], scores[order]
    if len(a) > 1:
        new = np.r_[True, (np.diff(a) != 0) | (np.diff(w) != 0) | (np.diff(ids) != 0) | (np.diff(scores) != 0)]
        a, w, ids, scores = a[new], w[new], ids[new], scores[new]
    group = np.flatnonzero(np.r_[True, (np.diff(a) != 0) | (np.diff(w) != 0)]) if len(a) else np.zeros(0, int)
    place = np.arange(len(a)) - np.repeat(group, np.diff(np.r_[group, len(a)]))
    return tuple(x[place < k] for x in (a, w, ids, scores))


def search(batches: Iterator[pd.DataFrame], anchors: tuple, low: np.ndarray, high: np.ndarray,
           k: int, alike: bool) -> Iterator[pd.DataFrame]:
    """For each anchor and window (a column of ``low`` and ``high``), the best ``k``
    rows of this task with scores from ``low`` to ``high``."""
    ids, labels, q, mean, dev = anchors
    low = low.copy()
    found = tuple(np.zeros(0, np.int64) for _ in range(4))
    step = TILE[1] >> 3
    for b in batches:
        r_ids, r_labels, r_q, r_mean, r_dev = loaded(b, q.shape[1])
        start = 0
        while start < len(r_ids):
            stop = min(start + step, len(r_ids))
            step = min(2 * step, TILE[1])       # the first few rows already give limits
            rows = {"id": r_ids[start:stop], "label": r_labels[start:stop], "levels": levels(r_mean[start:stop], r_dev[start:stop])}
            new = [found]
            for s in range(0, len(ids), TILE[0]):
                part = slice(s, s + TILE[0])
                some = {"id": ids[part], "label": labels[part], "levels": levels(mean[part], dev[part])}
                i, j = survivors(some, rows, alike, low[part].min(1), high[part].max(1))
                score = exact(q[part], r_q[start:stop], i, j)
                for w in range(low.shape[1]):
                    fits = (score >= low[part][i, w]) & (score <= high[part][i, w])
                    new.append((i[fits] + s, np.full(np.count_nonzero(fits), w), rows["id"][j[fits]], score[fits]))
            if len(new) > 1:
                found = top(*(np.concatenate(x) for x in zip(*new)), k)
                raise_limits(low, *found, k)
            start = stop
    yield pd.DataFrame(dict(zip(("a", "w", "id", "score"), found)))


def raise_limits(low: np.ndarray, a, w, ids, scores, k: int) -> None:
    """Where ``k`` rows are found, a further one must reach the last of them."""
    if len(a):
        last = np.flatnonzero(np.r_[(np.diff(a) != 0) | (np.diff(w) != 0), True])
        full = last[np.diff(np.r_[-1, last]) == k]
        low[a[full], w[full]] = np.maximum(low[a[full], w[full]], scores[full])


# ------------------------------------------------------------------- rounds

def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a", "w").orderBy(F.desc("score"), "id")
    return (found.dropDuplicates().withColumn("place", F.row_number().over(order))
            .filter(F.col("place") <= k).drop("place"))


def rounds_of(rows: DataFrame, n_rounds: int, anchors: tuple, low: np.ndarray, high: np.ndarray,
              k: int, alike: bool) -> DataFrame:
    """The best ``k`` rows of the whole table for each anchor and window."""
    spark = rows.sparkSession
    low, kept = low.copy(), None
    for r in range(n_rounds):
        sent = spark.sparkContext.broadcast((anchors, low, high))

        def task(batches, sent=sent):
            return search(batches, *sent.value, k, alike)

        some = rows.filter(F.col("round") == r).drop("round").mapInPandas(task, FOUND)
        kept = staged(best(some if kept is None else some.unionByName(kept), k), f"found-{r}")
        if r + 1 < n_rounds:
            f = kept.toPandas().sort_values(["a", "w", "score", "id"], ascending=[True, True, False, True])
            raise_limits(low, *(f[c].to_numpy(np.int64) for c in ("a", "w", "id", "score")), k)
    return kept


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label",
                   vec_col: str = "embedding", positives: int = 5, negatives: int = 10,
                   percent: tuple[int, int] = (30, 90), scale: float = 256.0) -> DataFrame:
    """One row per anchor, positive and hard negative: ``anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score``. ``is_anchor`` is a condition on ``id``."""
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vec_col).cast("array<double>").alias("vec"))
              .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & sound))
    n, dims = usable.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return spark.createDataFrame([], schema)
    columns, n_rounds = width(dims), 1
    while FIRST_ROWS * GROWTH ** (n_rounds - 1) < n:
        n_rounds += 1
    # which round: the share of hash values below 1 / GROWTH^k goes to the k-th from the end or earlier
    draw = F.pmod(F.xxhash64("id", "label", "q", "wide"), F.lit(GROWTH ** (n_rounds - 1)))
    r = sum((F.when(draw >= GROWTH ** k, 1).otherwise(0) for k in range(n_rounds - 1)), F.lit(0))
    kept = staged(usable.mapInPandas(lambda batches: stored(batches, scale), ROWS).withColumn("round", r), "summaries")

    chosen = kept.filter(is_anchor).drop("round").dropDuplicates()
    size = columns * 8 + 2 * (columns // SEGMENT) * 8 + positives * 64
    n_groups = max(1, math.ceil(chosen.count() * size / GROUP_BYTES))
    chosen = staged(chosen.withColumn("grp", F.pmod(F.xxhash64("id", "label", "q", "wide"), F.lit(n_groups))), "anchors")
    path = scratch_path(spark, "hard-negatives")
    for g in range(n_groups):
        anchors = loaded(chosen.filter(F.col("grp") == g).drop("grp").toPandas(), columns)
        if not len(anchors[0]):
            continue
        far = np.full((len(anchors[0]), 1), LONG)
        pos = rounds_of(kept, n_rounds, anchors, -far, far, positives, alike=True).toPandas()
        pos = pos.sort_values(["a", "score", "id"], ascending=[True, False, True])
        pos["w"] = pos.groupby("a").cumcount()
        low, high = np.full((2, len(anchors[0]), positives), LONG)
        high = -high                                              # a window that holds nothing
        at = pos["a"].to_numpy(), pos["w"].to_numpy()
        low[at] = [-(-percent[0] * int(s) // 100) for s in pos["score"]]
        high[at] = [percent[1] * int(s) // 100 for s in pos["score"]]
        neg = rounds_of(kept, n_rounds, anchors, low, high, negatives, alike=False)
        of = spark.createDataFrame(
            [(int(a), int(w), int(anchors[0][a]), int(i), int(s)) for a, w, i, s in pos[["a", "w", "id", "score"]].itertuples(index=False)],
            "a int, w int, anchor_id long, positive_id long, positive_score long")
        order = Window.partitionBy("a", "w").orderBy(F.desc("score"), "id")
        (neg.withColumn("rank", F.row_number().over(order)).join(of, ["a", "w"])
         .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                 F.col("score").alias("negative_score")).write.mode("append").parquet(f"{path}/grp={g}"))
    if n_groups == 1 and not len(anchors[0]):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/grp=*")
