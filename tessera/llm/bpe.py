"""Byte-level BPE encoding and decoding by overlapping chunks (operator 6).

1. A text of more than ``CHUNK`` characters is dealt out as overlapping chunks,
   so the chunks of one long document are pre-tokenised in many tasks. Shorter
   texts are one chunk and are not moved at all.
2. A match of the pattern depends on the text from its start on, not on what
   lies before. So where a boundary of one chunk's pre-tokens is a boundary of
   the next chunk's too, both go on alike from there: the seam is stitched at
   the first common boundary inside the overlap. Where a pre-token is longer
   than the overlap and no boundary is common, matching goes on from the last
   true boundary until the boundaries agree again.
3. Each pre-token is encoded by itself; ids of pre-tokens met before in the
   task come from a bounded memo. The new ones of some texts are merged together,
   a merge of each in one round.
4. Decoding looks every id up and concatenates raw bytes.

Defined results. Null text counts as empty and gives no ids; repeated rows give
repeated results; a null ``id_col`` is kept. Extra columns do not matter. The
rank file is a parameter and travels as a broadcast of its fixed size.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 15      # characters
OVERLAP = 1 << 10
SENT = 32            # chunks with their boundaries that a task returns at once
MEMO = 1 << 18       # pre-tokens remembered by a task, about
TOGETHER = 128       # texts whose new pre-tokens are merged together
NONE = 1 << 30       # above any rank: a pair that does not merge
LOOK = 2             # characters that a match reads past its end
LONG_PIECE = 64      # bytes from which merges go through a heap


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the neighbours of lowest rank, leftmost first, until none merges."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) >= LONG_PIECE:
        return _merge_long(piece, ranks)
    # Only the two pairs that a merge touches are looked up again.
    rank, none = ranks.get, len(ranks) << 32
    starts = list(range(len(piece) + 1))
    pairs = [rank(piece[i:i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (best := min(pairs)) != none:
        i = pairs.index(best)
        del pairs[i], starts[i + 1]
        if i < len(pairs):
            pairs[i] = rank(piece[starts[i]:starts[i + 2]], none)
        if i:
            pairs[i - 1] = rank(piece[starts[i - 1]:starts[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(starts, starts[1:])]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in O(n log n): a heap of mergeable neighbours over a linked list."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))   # by start of part
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1" * n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i] if alive[i] else n
        if not alive[i] or mid >= n or end[mid] != stop:
            continue    # one of the two has merged meanwhile
        end[i], alive[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


def load_pairs(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Which two tokens make a third: sorted ``left << 32 | right``, and its rank."""
    found = {a << 32 | b: r for whole, r in ranks.items() for i in range(1, len(whole))
             if (a := ranks.get(whole[:i])) is not None and (b := ranks.get(whole[i:])) is not None}
    keys = np.array(sorted(found), np.int64)
    return keys, np.array([found[k] for k in keys.tolist()], np.int64)


def merge_together(pieces: list[bytes], ranks: dict[bytes, int], pairs: tuple[np.ndarray, np.ndarray]) -> list[list[int]]:
    """``merge`` of many pieces of two bytes or more at once: a round merges the leftmost
    pair of lowest rank of each piece, and pieces without such a pair leave."""
    keys, values = pairs
    if not pieces or not len(keys):
        return [[ranks[p[i:i + 1]] for i in range(len(p))] for p in pieces]

    def rank(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, values[at], NONE)

    single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
    ids = single[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    joins = np.where(owner[1:] == owner[:-1], rank(ids[:-1], ids[1:]), NONE)
    joins = np.append(joins, NONE)                   # by the left one of the pair
    out = []
    while len(ids):
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        least = np.minimum.reduceat(joins << 32 | np.arange(len(ids)), first)
        open_ = least >> 32 < NONE
        stay = np.repeat(open_, np.diff(np.append(first, len(ids))))
        out.append((owner[~stay], ids[~stay]))
        at = least[open_] & 0xFFFFFFFF
        ids[at] = least[open_] >> 32
        stay[at + 1] = False
        at = (np.cumsum(stay) - 1)[at]
        ids, owner, joins = ids[stay], owner[stay], joins[stay]
        if not len(ids):
            break
        after = np.minimum(at + 1, len(ids) - 1)
        joins[at] = np.where((after > at) & (owner[after] == owner[at]), rank(ids[at], ids[after]), NONE)
        before = np.maximum(at - 1, 0)
        inside = (before < at) & (owner[before] == owner[at])
        joins[before[inside]] = rank(ids[before[inside]], ids[at[inside]])
    owner, ids = (np.concatenate(x) for x in zip(*out))
    ids = ids[np.argsort(owner, kind="stable")].tolist()
    ends = np.cumsum(np.bincount(owner, minlength=len(pieces))).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pairs: tuple[np.ndarray, np.ndarray] | None = None):
        self.ranks, self.pattern, self.pairs = ranks, regex.compile(pattern), pairs
        self.memo: dict[str, list[int]] = {}
        self.raw: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.raw[i] = b

    def piece(self, p: str) -> list[int]:
        ids = self.memo.get(p)
        if ids is None:
            ids = merge(p.encode(), self.ranks)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[p] = ids
        return ids

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def learn(self, texts: list[list[str]]) -> None:
        """Merge what is new in the pieces of some texts together, into the memo."""
        if len(self.memo) >= MEMO:
            self.memo.clear()
        new, raws = [], []
        for p in set().union(*texts).difference(self.memo):
            raw = p.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.memo[p] = [whole]
            elif len(raw) < LONG_PIECE:
                new.append(p)
                raws.append(raw)
        self.memo.update(zip(new, merge_together(raws, self.ranks, self.pairs)))

    def encode(self, pieces: list[str]) -> list[int]:
        memo, piece = self.memo, self.piece
        return list(chain.from_iterable([memo.get(p) or piece(p) for p in pieces]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


def boundaries(pieces: list[str], base: int) -> np.ndarray:
    """Where each piece starts, and the end of the last one, in the whole text."""
    return base + np.concatenate(([0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))))


def stitched(chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], text: str, codec: Codec,
             step: int) -> np.ndarray:
    """The ids of a whole text from those of its overlapping chunks.

    A chunk is (boundaries in the whole text, number of ids before each
    boundary, ids); chunk k starts at ``k * step``. A match reads ``LOOK``
    characters past its end at most, so boundaries nearer to a chunk's end may
    be wrong there."""
    out, at, k = [], 0, 0        # at: a true boundary, which chunk k has
    while True:
        bounds, before, ids = chunks[k]
        first = np.searchsorted(bounds, at)
        if k == len(chunks) - 1:
            out.append(ids[before[first]:])
            return np.concatenate(out)
        sound = bounds[first:np.searchsorted(bounds, bounds[-1] - LOOK, "right")]
        common = np.intersect1d(sound, chunks[k + 1][0])
        to = int(common[0] if len(common) else sound[-1] if len(sound) else at)
        out.append(ids[before[first]:before[np.searchsorted(bounds, to)]])
        at = to
        if len(common):
            k += 1
            continue
        for m in codec.pattern.finditer(text, at):   # a pre-token longer than the overlap
            out.append(np.array(codec.piece(m.group()), np.int32))
            at = m.end()
            k = min(at // step, len(chunks) - 1)
            bounds = chunks[k][0]
            i = np.searchsorted(bounds, at)
            if i < len(bounds) and bounds[i] == at and (k == len(chunks) - 1 or at <= bounds[-1] - LOOK):
                break


def digests(ids, raw: bytes, commas: list[str]) -> tuple[str, str]:
    return (hashlib.sha256(",".join(map(commas.__getitem__, ids)).encode()).hexdigest(),
            hashlib.sha256(raw).hexdigest())


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           finish=None, schema: str = "ids array<int>", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: ``id_col`` and what ``finish(codec)(ids)`` makes of
    its ids, of ``schema``; without ``finish``, the ids."""
    spark = docs.sparkSession
    table = load_ranks(rank_path)
    ranks, pairs = spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(load_pairs(table))
    names = [c.split()[0] for c in schema.split(",")]
    key_type = docs.schema[id_col].dataType.simpleString()

    def finisher(codec):
        return finish(codec) if finish else (lambda ids: (np.asarray(ids, np.int32),))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(ranks.value, pattern, pairs.value)
        done = finisher(codec)
        for b in batches:
            rows = []
            for i in range(0, len(b), TOGETHER):
                pieces = [codec.pieces(t) for t in b["text"].iloc[i:i + TOGETHER]]
                codec.learn(pieces)
                rows += [done(codec.encode(p)) for p in pieces]
            yield pd.DataFrame(rows, columns=names).assign(id=b["id"].array)[["id", *names]]

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(ranks.value, pattern, pairs.value)
        for b in (batch[i:i + SENT] for batch in batches for i in range(0, len(batch), SENT)):
            rows = []
            split = [codec.pieces(t) for t in b["text"]]
            codec.learn(split)
            for k, pieces in zip(b["k"], split):
                ids = [codec.piece(p) for p in pieces]
                rows.append((boundaries(pieces, int(k) * chunk).tobytes(),
                             np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int64).tobytes(),
                             np.array(list(chain.from_iterable(ids)), np.int32).tobytes()))
            yield b[["id", "mark", "k"]].assign(
                text=[t[:chunk] for t in b["text"]], **{n: [r[i] for r in rows] for i, n in enumerate(("bounds", "before", "ids"))})

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        codec = Codec(ranks.value, pattern)
        copies = int((pdf["k"] == 0).sum())          # rows that repeat id and text
        pdf = pdf.drop_duplicates("k").sort_values("k")
        chunks = [(np.frombuffer(a, np.int64), np.frombuffer(c, np.int64), np.frombuffer(i, np.int32))
                  for a, c, i in zip(pdf["bounds"], pdf["before"], pdf["ids"])]
        row = finisher(codec)(stitched(chunks, "".join(pdf["text"]), codec, chunk).tolist())
        out = pd.DataFrame([row] * copies, columns=names)
        out.insert(0, "id", [pdf["id"].iloc[0]] * copies)
        return out

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    out_schema = f"id {key_type}, {schema}"
    short = rows.filter(F.char_length("text") <= chunk).mapInPandas(whole, out_schema)
    piece = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    chunks = (rows.filter(F.char_length("text") > chunk)
              .select("id", F.sha2("text", 256).alias("mark"), piece.alias("own"))
              .select("id", "mark", F.posexplode(F.transform("own", lambda c, i: F.concat(
                  c, F.left(F.coalesce(F.get("own", i + 1), F.lit("")), F.lit(overlap))))).alias("k", "text"))
              .repartition("id", "mark", "k"))
    coded = chunks.mapInPandas(parts, f"id {key_type}, mark string, k int, text string, "
                                      "bounds binary, before binary, ids binary")
    long = coded.groupBy("id", "mark").applyInPandas(join_up, out_schema)
    return short.unionByName(long).withColumnRenamed("id", id_col)


def digest_rows(codec: Codec):
    """For ``finish``: number of ids, their digest, and that of the decoded bytes."""
    commas = [str(i) for i in range(len(codec.raw))]
    return lambda ids: (len(ids), *digests(ids, codec.decode(ids), commas))


def decode(coded: DataFrame, rank_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``raw``, the bytes that the ids stand for."""
    ranks = coded.sparkSession.sparkContext.broadcast(load_ranks(rank_path))
    key_type = coded.schema[id_col].dataType.simpleString()

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(ranks.value, "")
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "raw": [codec.decode(i if i is not None else ()) for i in b["ids"]]})

    return (coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
            .mapInPandas(back, f"id {key_type}, raw binary").withColumnRenamed("id", id_col))
