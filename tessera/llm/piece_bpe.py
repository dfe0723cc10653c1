"""SentencePiece encoding and decoding for merge-type vocabularies (operator 12).

1. A text becomes one string of symbols (characters), spaces written as ``MARK`` and
   one more ``MARK`` put in front where the model says so.
2. All pairs of neighbours that form a piece of the vocabulary go on an *agenda*
   ordered by score, best first, leftmost first among equals. The best pair
   merges; the pairs it makes with its new neighbours go on the agenda. A short
   string's agenda is a list by place, a longer one's a heap, whose entries are
   passed over when their symbols have merged meanwhile. A symbol that ends up as
   no piece is written as its bytes, or as the unknown id.
3. Merges never cross a place that no piece spans. Where no piece holds ``MARK``
   behind another character, the string is therefore cut in front of every run of
   ``MARK``, and the ids of strings met before come from a bounded memo of the
   worker, which keeps it for later tasks and forgets those not met for longest.
4. *Check in Arrow batches.* All strings that went over the agenda in a batch are
   put together and encoded by the sentencepiece library as well; the job stops
   with both results if they differ. Decoding is the library's ``decode``.

Defined results. A null text counts as empty; an empty text has no ids; repeated
rows give repeated results and a null ``id_col`` is kept; a very long text costs
n log n, and only its own task's memory. Extra columns do not matter. Models with
a normalisation table or with fixed symbols of the user are refused by ``load``.
The model is a parameter and travels as a broadcast of its fixed size.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
SHORT = 24           # characters up to which the agenda is a list
MEMO = 1 << 19       # strings in each of the two halves of a worker's memo ...
MEMO_LENGTH = 64     # ... of so many characters at most
CHECKED = 1 << 12    # characters that the library encodes in one call of the check

NORMAL, UNKNOWN, UNUSED, BYTE, USER = 1, 2, 5, 6, 4   # fixed values: kinds of pieces in a model file
BPE = 2                                               # fixed value: kind of model


class Model(NamedTuple):
    """Plain data, so that a broadcast of it needs no copy of this module."""
    order: dict[str, int]       # piece -> place in the order of merging, 0 first
    ids: dict[str, int]
    unused: frozenset
    byte_ids: list[int] | None  # by byte, with byte fallback
    unknown: int
    lead: str                   # put in front of a text that is not empty
    raw: bytes                  # the model file


def load(path: str) -> Model:
    from sentencepiece import sentencepiece_model_pb2
    with open(path, "rb") as f:
        raw = f.read()
    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(raw)
    norm, spec = m.normalizer_spec, m.trainer_spec
    if spec.model_type != BPE or spec.treat_whitespace_as_suffix:
        raise ValueError("only merge-type vocabularies with leading space marks are supported")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces \
            or any(p.type == USER for p in m.pieces):
        raise ValueError("models that normalise texts or fix symbols of the user are not supported")
    ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (NORMAL, UNUSED)}
    ranks = {s: k for k, s in enumerate(sorted({p.score for p in m.pieces}, reverse=True))}
    of_byte = {p.piece: i for i, p in enumerate(m.pieces) if p.type == BYTE}
    return Model({p: ranks[m.pieces[i].score] for p, i in ids.items()}, ids,
                 frozenset(p.piece for p in m.pieces if p.type == UNUSED),
                 [of_byte[f"<0x{b:02X}>"] for b in range(256)] if spec.byte_fallback else None,
                 next(i for i, p in enumerate(m.pieces) if p.type == UNKNOWN),
                 MARK if norm.add_dummy_prefix else "", raw)


def symbols(s: str, order: dict[str, int], parts: dict[str, tuple[str, str]] | None = None) -> list[str]:
    """What the characters of ``s`` merge to; ``parts``, if given, takes the two
    halves of every merge."""
    n = len(s)
    if n <= SHORT:
        return _symbols_of_short(s, order, parts)
    agenda = [(o, i, i + 2) for i in range(n - 1) if (o := order.get(s[i:i + 2])) is not None]
    heapq.heapify(agenda)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))     # by where a symbol starts
    gone = bytearray(n + 1)
    while agenda:
        _, left, stop = heapq.heappop(agenda)
        right = end[left]
        if gone[left] or right >= n or end[right] != stop:
            continue
        if parts is not None:
            parts[s[left:stop]] = s[left:right], s[right:stop]
        end[left] = stop
        gone[right] = 1
        if stop < n:
            before[stop] = left
            if (o := order.get(s[left:end[stop]])) is not None:
                heapq.heappush(agenda, (o, left, end[stop]))
        prev = before[left]
        if prev >= 0 and (o := order.get(s[prev:stop])) is not None:
            heapq.heappush(agenda, (o, prev, stop))
    out, i = [], 0
    while i < n:
        out.append(s[i:end[i]])
        i = end[i]
    return out


def _symbols_of_short(s: str, order: dict[str, int], parts: dict[str, tuple[str, str]] | None) -> list[str]:
    out, none = list(s), len(order)
    agenda = [order.get(a + b, none) for a, b in zip(s, s[1:])]     # by place; the first least entry is next
    while agenda and (best := min(agenda)) < none:
        k = agenda.index(best)
        left, right = out[k], out.pop(k + 1)
        out[k] = both = left + right
        if parts is not None:
            parts[both] = left, right
        del agenda[k]
        if k < len(agenda):
            agenda[k] = order.get(both + out[k + 1], none)
        if k:
            agenda[k - 1] = order.get(out[k - 1] + both, none)
    return out


class Coder:
    """Encoder and decoder of one worker."""

    def __init__(self, model: tuple, check: bool = True):
        from sentencepiece import SentencePieceProcessor
        (self.order, self.ids, self.unused, self.byte_ids, self.unknown, self.lead, raw) = model
        self.library = SentencePieceProcessor(model_proto=raw)
        self.check = check
        cuttable = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.order)
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if cuttable else "(?s).+").findall
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.fresh: list[str] = []      # strings of this batch that the library has not seen yet

    def strings(self, text: str) -> list[str]:
        return self.cut(self.lead + text.replace(" ", MARK)) if text else []

    def _ids(self, symbol: str, parts: dict) -> list[int]:
        if symbol in self.unused and symbol in parts:    # may help merging, but is no result
            return [i for p in parts[symbol] for i in self._ids(p, parts)]
        if (i := self.ids.get(symbol)) is not None:
            return [i]
        return [self.byte_ids[b] for b in symbol.encode()] if self.byte_ids else [self.unknown]

    def _coded(self, s: str) -> tuple[int, ...]:
        parts = {} if self.unused else None
        found = symbols(s, self.order, parts)
        if not self.unused and None not in (ids := [*map(self.ids.get, found)]):
            return tuple(ids)
        return tuple(chain.from_iterable([self._ids(p, parts or {}) for p in found]))

    def of_string(self, s: str) -> tuple[int, ...]:
        """The ids of a string that the newer half of the memo does not hold."""
        if (ids := self.older.get(s)) is None:
            ids = self._coded(s)
            if self.check:
                self.fresh.append(s)
        if len(s) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[s] = ids
        return ids

    def _joined(self, runs) -> list[int]:
        ids = list(chain.from_iterable(runs))
        if self.byte_ids is None:       # neighbours without a piece are one unknown symbol
            ids = [x for k, x in enumerate(ids) if x != self.unknown or not k or ids[k - 1] != x]
        return ids

    def encode(self, text: str) -> list[int]:
        memo, of_string = self.memo, self.of_string
        return self._joined([memo.get(s) or of_string(s) for s in self.strings(text)])

    def compare(self) -> None:
        """The strings since the last call, put together, against the library."""
        fresh, self.fresh = self.fresh, []
        start = 0
        while start < len(fresh):
            size, stop = 0, start
            while stop < len(fresh) and size < CHECKED:
                size += len(fresh[stop])
                stop += 1
                if not fresh[stop - 1].strip(MARK):     # would run into the marks of the next string
                    break
            some, start = fresh[start:stop], stop
            text = "".join(some)
            if self.lead:       # every string starts with the mark that the library puts in front
                text = text[len(self.lead):]
            if not text:
                continue
            own = self._joined([self.memo.get(s) or self.older.get(s) or self._coded(s) for s in some])
            ids = self.library.encode(text)
            if own != ids:
                raise ValueError(f"the sentencepiece library encodes {text[:200]!r} as {ids[:50]}, not {own[:50]}")

    def decode(self, runs: list[list[int]]) -> list[str]:
        return self.library.decode(runs) if runs else []


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
           finish=None, schema: str = "ids array<int>", check: bool = True) -> DataFrame:
    """One row per document: ``id_col`` and what ``finish(coder)(runs)`` makes of a
    batch's lists of ids, a list of rows of ``schema``; without ``finish``, the ids."""
    model = docs.sparkSession.sparkContext.broadcast({"model": tuple(load(model_path))})
    names = [c.split()[0] for c in schema.split(",")]
    key_type = docs.schema[id_col].dataType.simpleString()

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = model.value              # a worker keeps it, and the coder with it, for later tasks
        coder = held["coder"] = held.get("coder") or Coder(held["model"], check)
        done = finish(coder) if finish else (lambda runs: [(np.asarray(r, np.int32),) for r in runs])
        for b in batches:
            runs = [coder.encode(t) for t in b["text"]]
            coder.compare()
            yield pd.DataFrame(done(runs), columns=names).assign(id=b["id"].array)[["id", *names]]

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(coded, f"id {key_type}, {schema}").withColumnRenamed("id", id_col)


def digest_rows(coder: Coder):
    """For ``finish``: number of ids, their digest, and that of the decoded text."""
    commas = [str(i) for i in range(coder.library.get_piece_size())]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()      # noqa: E731

    def rows(runs):
        return [(len(r), sha(",".join(map(commas.__getitem__, r))), sha(t)) for r, t in zip(runs, coder.decode(runs))]
    return rows


def decode(coded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text``, what the ids stand for; null ids give an empty text."""
    model = coded.sparkSession.sparkContext.broadcast(tuple(load(model_path)))
    key_type = coded.schema[id_col].dataType.simpleString()

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(model.value, check=False)
        for b in batches:
            runs = [list(map(int, i)) if i is not None else [] for i in b["ids"]]
            yield pd.DataFrame({"id": b["id"], "text": coder.decode(runs)})

    return (coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
            .mapInPandas(back, f"id {key_type}, text string").withColumnRenamed("id", id_col))
