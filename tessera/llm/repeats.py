"""Suffix-array dedup by bucket-pointer refinement (operator 9).

Task: remove every byte that lies in a string of ``LENGTH`` bytes which also
starts anywhere else in the table.

Sorting all suffixes of a corpus moves many times the corpus. Here only chosen
suffixes get buckets, and the answer is still exact:

1. *Initial q-gram buckets.* Of the q-grams inside each LENGTH-byte window (there
   are ``SPAN`` of them, q = LENGTH - SPAN + 1) the one of smallest hash, the
   leftmost of equals, is the window's anchor. It depends on the window's bytes
   alone, so equal windows have equal anchors at equal offsets. About two anchors
   per SPAN bytes remain, and the bucket of an anchor is its q-gram's hash.
   Windows whose anchor is alone in its bucket do not repeat.
2. *Refinement.* Around an anchor lie SPAN windows. A bucket is split by the
   identifier (128 bits) of the longer string that all these windows cover
   together. Where two members agree, all their windows repeat. Where they do
   not, the windows are split into FAN parts. The bytes that the windows of one
   part share reach further than the q-gram, on both sides: this is the part's
   new bucket, again split by the identifier of all that its windows cover, down
   to single windows.
3. *Updates are reused.* Members that agreed are settled, and one of them stands
   for all in later rounds; a bucket with one member left is dropped. So exact
   copies are done in the first round however many there are, and later rounds
   hold little but the ends of matches. There are log_FAN(SPAN) + 1 rounds.

A string over the edge of a document is cut there and the cut is part of its
identifier. Texts are moved twice: to the documents that have a repeated q-gram,
and of those to where something is removed. Hot buckets fold in partial
aggregation; joins run between exchanges that adaptive execution splits.

Defined results. Null counts as empty; texts under LENGTH bytes lose nothing.
Repeated rows (equal id and text) repeat each other. A null id is kept. What is
left of a text may not be valid UTF-8, so ``kept`` is binary. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged

LENGTH = 400
SPAN = 256          # q-grams per window; a power of FAN
FAN = 4
BUFFER = 1 << 18    # bytes handled at a time; at most 2^19 with a long text's overlap
SHIFT = np.int64(20)
_rnd = np.random.default_rng(977)
BYTE = _rnd.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = int(_rnd.integers(1 << 40, 1 << 62, dtype=np.uint64)) * 2 + 1


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2^64, by doubling."""
    out, k = np.ones(n, np.uint64), 1
    while k < n:
        out[k:2 * k] = out[:min(k, n - k)] * np.uint64(pow(base, k, 1 << 64))
        k *= 2
    return out


class Anchors:
    """Finds the anchors of all windows in a buffer of bytes."""

    def __init__(self, length: int, span: int):
        self.length, self.span, self.q = length, span, length - span + 1
        n = 2 * BUFFER + 2 * length
        self.up, self.down = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n + 1)

    def find(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """Of texts ``raw[begin:end]`` laid end to end: for every run of windows
        with the same anchor (text, anchor, first window, last window, hash);
        positions are in the buffer."""
        n = len(raw)
        if n < self.length:
            return None
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[raw] * self.down[:n], out=sums[1:])
        grams = (sums[self.q:] - sums[:-self.q]) * self.up[:n - self.q + 1]
        grams ^= grams >> np.uint64(31)
        grams *= np.uint64(0x9E3779B97F4A7C15)
        low = (grams >> np.uint64(1)).astype(np.int64)
        low = (low >> SHIFT << SHIFT) | np.arange(len(low), dtype=np.int64)   # hash, then position
        least, width = low, 1
        while 2 * width <= self.span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < self.span:
            least = np.minimum(least[:len(least) - (self.span - width)], least[self.span - width:])
        anchor = least & ((np.int64(1) << SHIFT) - 1)                          # of the window at each position
        text = np.repeat(np.arange(len(begin)), end - begin)[:len(anchor)]
        inside = np.arange(len(anchor)) + self.length <= end[text]
        at = np.flatnonzero(inside)
        if not len(at):
            return None
        a, t = anchor[at], text[at]
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (t[1:] != t[:-1]))))
        last = np.concatenate((new[1:], [len(at)])) - 1
        return t[new], a[new], at[new], at[last], grams[a[new]].view(np.int64)


def _buffers(raws: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], bytes]]:
    """(texts, offsets in them, bytes): short texts together, long ones in
    pieces that overlap so that each window is whole in one piece."""
    which, parts, size = [], [], 0
    for i, raw in enumerate(raws):
        if len(raw) < length:
            continue
        for k in range(0, len(raw) - length + 1, BUFFER):
            part = raw[k:k + BUFFER + length - 1]
            which.append((i, k))
            parts.append(part)
            size += len(part)
            if size >= BUFFER:
                yield which, parts
                which, parts, size = [], [], 0
    if parts:
        yield which, parts


def _joined(pieces: list[tuple]) -> tuple:
    """The anchors of a text from those of its pieces: an anchor whose windows
    begin in two pieces is one. Anchors never come before those of earlier windows."""
    if not pieces:
        return [], [], [], []
    at, low, high, h = (np.concatenate(x) for x in zip(*pieces))
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[new], np.minimum.reduceat(low, new), np.maximum.reduceat(high, new), h[new]


def _table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs as (id, text_key, raw): null texts are empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("raw"))


def _anchored(table: DataFrame, length: int, span: int) -> DataFrame:
    """Per row: id, text_key, bytes, digest, and its anchors as parallel arrays."""
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Anchors(length, span)
        with np.errstate(over="ignore"):
            for b in batches:
                raws = [bytes(r) for r in b["raw"]]
                found: list[list] = [[] for _ in raws]
                for which, parts in _buffers(raws, length):
                    size = np.array([len(p) for p in parts])
                    end = np.cumsum(size)
                    got = finder.find(np.frombuffer(b"".join(parts), np.uint8), end - size, end)
                    if got is None:
                        continue
                    t, a, first, last, h = got
                    cut = np.searchsorted(t, np.arange(len(parts) + 1))
                    for j, (i, k) in enumerate(which):
                        s, base = slice(cut[j], cut[j + 1]), k - (end - size)[j]
                        found[i].append((a[s] + base, a[s] - last[s], a[s] - first[s], h[s]))
                found = [_joined(f) for f in found]
                columns = [[f[c] for f in found] for c in range(4)]
                yield pd.DataFrame({"id": b["id"].array, "text_key": b["text_key"], "n_bytes": [len(r) for r in raws],
                                    "digest": [hashlib.sha256(r).digest() for r in raws], "at": columns[0],
                                    "low": columns[1], "high": columns[2], "hash": columns[3]})

    kind = table.schema["id"].dataType.simpleString()
    return table.mapInPandas(build, f"id {kind}, text_key long, n_bytes long, digest binary, at array<int>, "
                                    "low array<short>, high array<short>, hash array<long>")


def part_of(context: bytes, left: int, right: int, length: int, span: int, first: int, size: int):
    """Of the windows that start ``first`` to ``first + size - 1`` bytes before
    an anchor: (bytes that all of them share, all bytes they cover, smallest and
    largest of those offsets that are inside the document), or None if none is.

    ``context`` is the text from ``span - 1`` bytes before the anchor to
    ``length`` after it, of which ``left`` and ``right`` bytes are over the edge."""
    high = min(first + size - 1, span - 1 - left)
    low = max(first, right)
    if low > high:
        return None
    zero = span - 1 - left                       # the anchor in the context
    shared = context[zero - first:zero - (first + size - 1) + length]
    covered = context[max(0, zero - (first + size - 1)):zero - first + length]
    return shared, covered, low, high


def _identifier(covered: bytes, first: int, size: int, low: int, high: int) -> bytes:
    """Equal identifiers: equal windows at equal offsets, and equally many."""
    return xxhash.xxh3_128_digest(b"%d,%d,%d,%d:" % (first, size, low, high) + covered)


def _split(members: DataFrame, fan: int) -> tuple[DataFrame, DataFrame]:
    """One round: (settled members, representatives whose buckets stay open)."""
    groups = staged(members.groupBy("bucket", "full").agg(
        F.count("*").alias("n"), F.min(F.struct("silent", "row", "at", "first")).alias("rep")), "repeat-groups")
    agreed = groups.filter("n > 1").select("full")
    settled = members.filter("not silent").join(agreed, "full", "left_semi")
    open_ = staged(groups.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1").select("bucket"), "repeat-open")
    stay = groups.join(open_, "bucket", "left_semi").select(
        F.col("rep.row").alias("row"), F.col("rep.at").alias("at"), F.col("rep.first").alias("first"),
        (F.col("rep.silent") | (F.col("n") > 1)).alias("silent"))
    return settled, stay


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   span: int = SPAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, spans): every row with its size and digest; the texts of rows
    that have a repeated q-gram; and stretches of bytes to remove, by row. The
    stretches may overlap; every stretch is covered by repeated windows."""
    table = _table(docs, id_col, text_col)
    rows = staged(_anchored(table, length, span).withColumn("row", F.monotonically_increasing_id()), "repeat-anchors")
    repeated = staged(rows.select(F.explode("hash").alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))
                      .filter("n > 1").select("hash"), "repeat-buckets")
    anchors = (rows.select("row", F.explode(F.arrays_zip("at", "low", "high", "hash")).alias("a")).select("row", "a.*")
               .join(repeated, "hash", "left_semi"))
    by_row = (anchors.groupBy("row").agg(F.collect_list(F.struct("at", "low", "high", "hash")).alias("anchors"))
              .join(rows.select("row", "id", "text_key"), "row"))
    texts = staged(table.join(by_row.withColumnsRenamed({"id": "_id", "text_key": "_key"}),
                              F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
                   .select("row", "raw", "anchors"), "repeat-texts")

    def first_round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row, raw, anchors in zip(b["row"], b["raw"], b["anchors"]):
                for x in anchors:
                    at = x["at"]
                    left, right = max(0, span - 1 - at), max(0, at + length - len(raw))
                    covered = raw[max(0, at - span + 1):at + length]
                    low, high = right, span - 1 - left
                    out.append((row, at, 0, False, x["hash"].to_bytes(8, "big", signed=True),
                                _identifier(covered, 0, span, low, high), at - high, at - low + length))
            yield pd.DataFrame(out, columns=MEMBER)

    members = staged(texts.mapInPandas(first_round, MEMBER_SCHEMA), "repeat-members")
    settled, stay = _split(members, FAN)
    spans = [settled.select("row", "from", "to")]

    # The bytes around the anchors that are still open go along from here on.
    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row, raw, anchors, open_ in zip(b["row"], b["raw"], b["anchors"], b["open"]):
                need = {x["at"]: (x["low"], x["high"]) for x in anchors}
                for x in open_:
                    at = x["at"]
                    out.append((row, at, x["silent"], *need[at], max(0, span - 1 - at), max(0, at + length - len(raw)),
                                raw[max(0, at - span + 1):at + length]))
            yield pd.DataFrame(out, columns=["row", "at", "silent", "low", "high", "left", "right", "context"])

    by_row = stay.groupBy("row").agg(F.collect_list(F.struct("at", "silent")).alias("open"))
    around = staged(texts.join(by_row, "row").mapInPandas(
        contexts, "row long, at int, silent boolean, low int, high int, left int, right int, context binary")
        .dropDuplicates(["row", "at"]), "repeat-contexts")
    parts = around.select("*", F.lit(0).alias("first"))
    size = span
    while size > 1:
        size //= FAN
        members = staged(parts.mapInPandas(_children(length, span, size), MEMBER_SCHEMA), "repeat-members")
        settled, stay = _split(members, FAN)
        spans.append(settled.select("row", "from", "to"))
        if size > 1:
            stay = staged(stay, "repeat-stay")
            if stay.isEmpty():
                break
            parts = stay.join(around.drop("silent"), ["row", "at"])
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return rows, texts, out


MEMBER = ["row", "at", "first", "silent", "bucket", "full", "from", "to"]
MEMBER_SCHEMA = ("row long, at int, first int, silent boolean, bucket binary, full binary, `from` long, `to` long")


def _children(length: int, span: int, size: int):
    """The FAN parts of ``size`` windows of each open part, as new members. A
    part outside the anchor's own windows is left to the anchors it belongs to."""
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row, at, silent, low, high, left, right, context, begin in zip(
                    b["row"], b["at"], b["silent"], b["low"], b["high"], b["left"], b["right"], b["context"], b["first"]):
                for first in range(begin, begin + FAN * size, size):
                    if first > high or first + size - 1 < low:
                        continue
                    got = part_of(context, left, right, length, span, first, size)
                    if got:
                        shared, covered, lo, hi = got
                        out.append((row, at, first, silent, xxhash.xxh3_128_digest(b"%d:" % first + shared),
                                    _identifier(covered, first, size, lo, hi), at - hi, at - lo + length))
            yield pd.DataFrame(out, columns=MEMBER)
    return build


def merged(begins, ends) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open intervals."""
    out: list[list[int]] = []
    for a, b in sorted(zip(begins, ends)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                    span: int = SPAN, bytes_too: bool = False) -> DataFrame:
    """One row per document: ``id_col``, n_bytes, n_removed, n_spans and
    kept_sha256; with ``bytes_too`` also ``kept``, null where all is kept."""
    rows, texts, spans = repeated_spans(docs, id_col, text_col, length, span)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row, raw, begins, ends in zip(b["row"], b["raw"], b["begins"], b["ends"]):
                runs, kept, at = merged(begins, ends), [], 0
                for x, y in runs:
                    kept.append(raw[at:x])
                    at = y
                rest = b"".join([*kept, raw[at:]])
                out.append((row, sum(y - x for x, y in runs), len(runs), hashlib.sha256(rest).digest(),
                            rest if bytes_too else None))
            yield pd.DataFrame(out, columns=["row", "n_removed", "n_spans", "kept_digest", "kept"])

    by_row = spans.distinct().groupBy("row").agg(F.collect_list(F.struct("from", "to")).alias("s")).select(
        "row", F.col("s.from").alias("begins"), F.col("s.to").alias("ends"))
    changed = texts.select("row", "raw").join(by_row, "row").mapInPandas(
        cut, "row long, n_removed long, n_spans long, kept_digest binary, kept binary").dropDuplicates(["row"])
    out = rows.select("row", "id", "n_bytes", "digest").join(changed, "row", "left").select(
        F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.lower(F.hex(F.coalesce("kept_digest", "digest"))).alias("kept_sha256"), "kept")
    return out if bytes_too else out.drop("kept")
