"""Benchmark decontamination by a generalised suffix automaton (operator 3).

The normalised words of all test items go into one suffix automaton over word
numbers. Every document is streamed through it once: the state tells the
longest run of words ending here that occurs in some item. A run of
``min_words`` or more hits its last ``min_words`` words; an item of fewer words
is looked for whole, along the suffix links.

The items are a stated query set. They are taken in blocks of at most
``block_words`` words, one automaton a block, so the broadcast has a fixed
bound whatever the benchmark's size; each block passes over all documents, and
the rows are written between passes. Documents are never shuffled, so no key
can be hot.

Defined results. Null and empty texts have no words and are never hit; items
without words hit nothing; items with equal text all count. Items with a null
id hit words but are no item of the list. Repeated rows give repeated results;
a null ``id_col`` is kept. Extra columns are ignored by ``contamination`` and
untouched by ``decontaminate``. An empty benchmark or table gives clean or no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prefix, staged
from tessera.llm.workers import received, sent

MIN_WORDS = 10
MAX_COVERAGE = 0.5
BLOCK_WORDS = 1 << 17   # about 100 MB of automaton
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")   # of lower-cased UTF-8: 0-9, a-z and all beyond ASCII


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []    # bytes.lower changes A-Z only


class Automaton:
    """Generalised suffix automaton of token sequences."""

    def __init__(self, items: list[tuple[object, list[bytes]]], min_words: int):
        self.min_words = min_words
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        seqs = []
        for key, words in items:
            seq = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            seqs.append((key, seq))
            last = 0
            for c in seq:
                last = self._extend(last, c)
        # Per state: windows of min_words words, and whole short items, that end here.
        self.items: dict[int, set] = {}
        self.whole: dict[int, dict[int, set]] = {}
        for key, seq in seqs:
            if 0 < len(seq) < min_words:
                state = self._walk(seq)
                self.whole.setdefault(state, {}).setdefault(len(seq), set()).add(key)
                continue
            state = size = 0
            for c in seq:
                state, size = self.step(state, size, c)
                if size >= min_words:
                    self.items.setdefault(self._window(state), set()).add(key)
        # Nearest state on the way up the suffix links, itself included, with a whole short item.
        self.short = [-1] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.short[v] = v if v in self.whole else self.short[self.link[v]]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        """Split off of ``q`` the strings of at most length(p) + 1 words."""
        new = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[new] = self.link[q]
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _walk(self, seq: list[int]) -> int:
        state = 0
        for c in seq:
            state = self.next[state][c]
        return state

    def step(self, state: int, size: int, c: int) -> tuple[int, int]:
        """The longest match that ends with word ``c``."""
        nxt = self.next
        while c not in nxt[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            size = self.length[state]
        return nxt[state][c], size + 1

    def _window(self, state: int) -> int:
        """The state of the last ``min_words`` words of ``state``."""
        while self.length[self.link[state]] >= self.min_words:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Maximal runs [from, to) of hit words, and the items that hit."""
        runs: list[tuple[int, int]] = []
        found: set = set()
        get, nxt, link, length, short, least = (self.vocab.get, self.next, self.link, self.length,
                                                self.short, self.min_words)
        any_short = bool(self.whole)
        state = size = 0
        for j, w in enumerate(words):
            c = get(w)
            if c is None:
                state = size = 0
                continue
            while (to := nxt[state].get(c)) is None:
                state = link[state]
                if state < 0:
                    state = size = 0
                    break
                size = length[state]
            else:
                state, size = to, size + 1
            begin = None
            if size >= least:
                begin = j + 1 - least
                found |= self.items.get(self._window(state), ())
            if any_short and (v := short[state]) > 0:
                while v > 0:
                    for n, keys in self.whole[v].items():
                        if n <= size:
                            begin = j + 1 - n if begin is None else min(begin, j + 1 - n)
                            found |= keys
                    v = short[link[v]] if link[v] > 0 else -1
            if begin is not None:
                while runs and runs[-1][1] >= begin:
                    begin = min(begin, runs.pop()[0])
                runs.append((begin, j + 1))
        return runs, found


def _merged(a: list, b: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted([*map(tuple, a), *map(tuple, b)]):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _without(text: str, runs: list) -> str:
    """The text less its hit words and what stands between them in a run."""
    raw, spans = text.encode(), [m.span() for m in WORD.finditer(text.encode().lower())]
    out, at = [], 0
    for begin, end in runs:
        out.append(raw[at:spans[begin][0]])
        at = spans[end - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def _blocks(items: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list]:
    """The items in blocks of about ``block_words`` words, read one by one.
    Equal texts share a block and add no states to its automaton."""
    counted = items.select(F.col(item_col).cast("string").alias("item"),
                           F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = counted.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = 1 + total // (2 * block_words)      # a word and its gap are two characters at least
    for b in range(n):
        yield counted.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == b).collect()


HITS = "n_words long, runs array<array<int>>, items array<string>"


def _scanner(auto, cut: bool):
    @F.pandas_udf(f"clean string, {HITS}")
    def scan(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        a = received(auto)
        for texts, cleans in batches:
            rows = []
            for text, clean in zip(texts, cleans):
                words = words_of(text)
                runs, found = a.scan(words)
                again = runs
                if cut and clean is not None:
                    again = runs if clean == text else a.scan(words_of(clean))[0]
                    while again:
                        clean = _without(clean, again)
                        again = a.scan(words_of(clean))[0]
                rows.append((clean, len(words), [list(r) for r in runs], sorted(x for x in found if x is not None)))
            yield pd.DataFrame(rows, columns=["clean", "n_words", "runs", "items"])

    return scan.asNondeterministic()


def _scanned(docs: DataFrame, items: DataFrame, text_col: str, item_col: str, item_text_col: str,
             min_words: int, block_words: int, cut: bool) -> DataFrame:
    """``docs`` with a struct of HITS, its name ``prefix(docs)`` and ``hits``; with
    ``cut`` also ``clean``, the text without its runs (looked at again until none is left)."""
    p = prefix(docs)
    clean, hit, before, new = p + "clean", p + "hits", p + "before", p + "got"
    sc, out = docs.sparkSession.sparkContext, docs.withColumn(clean, F.col(text_col))
    for k, block in enumerate(_blocks(items, item_col, item_text_col, block_words)):
        auto = sent(sc, Automaton([(r["item"], w) for r in block if (w := words_of(r["text"]))], min_words))

        if k:   # written between passes, so that a worker holds one automaton
            out = staged(out, "decontam").withColumnRenamed(hit, before)
        got = out.withColumn(new, _scanner(auto, cut)(F.col(text_col), F.col(clean)))
        hits = F.struct(F.col(f"{new}.n_words"), F.col(f"{new}.runs"), F.col(f"{new}.items"))
        if k:
            hits = F.struct(F.col(f"{new}.n_words"), F.concat(f"{before}.runs", f"{new}.runs").alias("runs"),
                            F.array_union(f"{before}.items", f"{new}.items").alias("items"))
        out = got.withColumns({hit: hits, clean: F.col(f"{new}.clean")}).drop(new, before)
    return out


def _summary(hits: str):
    """n_hit, and the digest of the items, of a HITS struct."""
    @F.pandas_udf("n_hit long, digest string")
    def summary(runs: pd.Series, items: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(sum(e - b for b, e in _merged(r, [])),
                              hashlib.sha256(",".join(sorted(i)).encode()).hexdigest())
                             for r, i in zip(runs, items)], columns=["n_hit", "digest"])

    return summary.asNondeterministic()(f"{hits}.runs", f"{hits}.items")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", min_words: int = MIN_WORDS,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_hit, n_items, items_sha256,
    contaminated."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    got = _scanned(rows, items, "text", item_col, item_text_col, min_words, block_words, cut=False)
    got = got.withColumn("_s", _summary("_hits"))
    return got.select(
        F.col("id").alias(id_col), "_hits.n_words", F.col("_s.n_hit").alias("n_hit"),
        F.size("_hits.items").cast("long").alias("n_items"), F.col("_s.digest").alias("items_sha256"),
        (F.col("_s.n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", min_words: int = MIN_WORDS, max_coverage: float = MAX_COVERAGE,
                  block_words: int = BLOCK_WORDS, length_col: str | None = None) -> DataFrame:
    """``docs`` without the spans of ``min_words`` or more test words (and whole
    shorter items), and without the documents of which such spans cover more
    than ``max_coverage`` of the words. Documents without a hit are unchanged;
    of changed ones ``length_col`` takes the new number of characters."""
    got = _scanned(docs, items, text_col, item_col, item_text_col, min_words, block_words, cut=True)
    p = prefix(docs)
    clean, total = p + "clean", p + "summary"
    got = got.withColumn(total, _summary(p + "hits"))
    kept = got.filter(F.col(f"{total}.n_hit") <= F.col(f"{p}hits.n_words") * F.lit(max_coverage))
    if length_col:
        same = F.col(clean).eqNullSafe(F.col(text_col))
        kept = kept.withColumn(length_col, F.when(same, F.col(length_col)).otherwise(F.char_length(clean).cast("long")))
    return kept.withColumn(text_col, F.col(clean)).select(*docs.columns)
