"""Language ID by prediction by partial matching (operator 1).

Statistics. Every labelled training text is read as bytes: A-Z fold to a-z, all
other ASCII counts as one separator (runs count once), bytes beyond ASCII stand
for themselves. Tasks count strings of four symbols per language; Spark sums
the counts, so a hot language is folded before the shuffle. The
most frequent strings of each language go to the driver, ``MODEL_GRAMS`` in all.

Model. One context tree of depth ``DEPTH`` serves all languages: its nodes are
the most frequent contexts, as many as ``TABLE_BYTES`` allow, closed under
suffixes. At a node a language that knows the context codes a symbol by its
count there or escapes (method C, with exclusion) to the next shorter context;
one that does not goes straight to the shorter one. The statistics are frozen,
so the code length of each symbol at each node is worked out once, exactly, and
scoring is a table look-up per byte: the code length of a whole text under each
language. ``score`` is the posterior of the shortest code under equal priors.

No language. ``identified`` drops a text whose best code is no shorter than the
shortest order-0 code of any language, from the same statistics: letters follow each other there
as in no learned language (dumps, random letters, other languages and scripts).
A text stays all the same where more than half of its words have a shorter code than
that: a key or a dump inside a short text does not make it foreign.
A labelled row must not vouch for itself, so ``Halves`` judges it by the model of
the other half of the rows (copies share a half). Where that half has fewer than
``HALF_ROWS`` rows of its language, the model of all rows judges it.

Defined results. Null and empty texts, and texts without a letter, are ``und``
with score 0. Equal code lengths go to the first language in sorted order. With
no labelled row every text is ``und``, and ``identified`` drops only texts without a
letter: there is nothing to judge by. Null labels train nothing. Repeated rows
give repeated results; extra columns are ignored by ``predict`` and kept by
``identified``. Texts of any length are read whole, in slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, prefix, staged
from tessera.llm.workers import received, sent

DEPTH = 3                   # symbols of context at most
MODEL_GRAMS = 1_000_000     # strings kept, as many for each language: the model's bound
TABLE_BYTES = 16 << 20      # code lengths: nodes x symbols x languages
SLICE = 1 << 20             # symbols scored at a time
HELD = 1 << 22              # strings that a task holds before it counts those of a language
HALF_ROWS = 20              # rows of a language that a half must have to judge the other
SYMBOLS = 1 + 26 + 128
CLASS = bytes(27 + b - 128 if b >= 128 else (b | 32) - 96 if chr(b).isalpha() else 0 for b in range(256))
NOBODY = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def symbols(text: str) -> np.ndarray:
    """The text as symbols behind ``DEPTH`` separators; runs of separators are one."""
    s = np.frombuffer(b"\0" + text.encode("utf-8", "replace").translate(CLASS) + b"\0", np.uint8)
    return np.concatenate((np.zeros(DEPTH - 1, np.uint8), s[:1], s[1:][(s[1:] | s[:-1]) != 0]))


def grams(s: np.ndarray, n: int) -> np.ndarray:
    """The string of ``n`` symbols that ends at each position from n - 1 on, as a number."""
    out = s[:len(s) - n + 1].astype(np.int32)
    for k in range(1, n):
        out *= SYMBOLS
        out += s[k:len(s) - n + 1 + k]
    return out


def count_grams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) over all rows of ``docs`` with a language and a text."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(lang):
            size.pop(lang)
            gram, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            return pd.DataFrame({"lang": lang, "gram": gram, "n": n})

        held: dict[str, list] = {}
        size: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                got = grams(symbols(text), DEPTH + 1)
                held.setdefault(lang, []).append(got)
                size[lang] = size.get(lang, 0) + len(got)
                if sum(size.values()) > HELD:
                    yield flush(max(size, key=size.get))
        for lang in list(held):
            yield flush(lang)

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    return (rows.mapInPandas(count, "lang string, gram int, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


class Model:
    """Frozen code lengths: ``bits[node * SYMBOLS + symbol]`` has one for each language."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        if not self.langs:
            return
        by = {lang: (g["gram"].to_numpy(np.int64), g["n"].to_numpy(np.float64)) for lang, g in counts.groupby("lang")}
        limit = max(1, TABLE_BYTES // (SYMBOLS * 4 * len(self.langs)))
        # Contexts of every length with their counts over all languages; the most frequent are nodes.
        found = []
        for d in range(DEPTH + 1):
            ctx = np.concatenate([g // SYMBOLS % SYMBOLS ** d for g, _ in by.values()])
            keys, at = np.unique(ctx, return_inverse=True)
            found.append((keys, np.bincount(at, np.concatenate([n for _, n in by.values()]))))
        depth = np.concatenate([np.full(len(k), d) for d, (k, _) in enumerate(found)])
        key = np.concatenate([k for k, _ in found])
        total = np.concatenate([n for _, n in found])
        top = np.lexsort((key, depth, -total))[:limit]   # a suffix is as frequent and shorter: it comes first
        self.nodes = [np.sort(key[top[depth[top] == d]]) for d in range(DEPTH + 1)]
        base = np.cumsum([0, *map(len, self.nodes)])
        bits = np.empty((base[-1], SYMBOLS, len(self.langs)), np.float32)
        for x, lang in enumerate(self.langs):
            gram, n = by[lang]
            parent = np.full((1, SYMBOLS), 1 / SYMBOLS)
            rows = []
            for d, keys in enumerate(self.nodes):
                ctx = gram // SYMBOLS % SYMBOLS ** d
                at = np.searchsorted(keys, ctx)
                ok = at < len(keys)
                ok[ok] = keys[at[ok]] == ctx[ok]
                seen = np.bincount(at[ok] * SYMBOLS + gram[ok] % SYMBOLS, n[ok],
                                   len(keys) * SYMBOLS).reshape(-1, SYMBOLS)
                up = np.zeros(len(keys), int) if not d else np.searchsorted(self.nodes[d - 1], keys % SYMBOLS ** (d - 1))
                rows.append(_coded(seen, parent[up]))
                parent = rows[-1]
            bits[:, :, x] = -np.log2(np.concatenate(rows))
        self.bits = bits.reshape(-1, len(self.langs))

    def table(self) -> np.ndarray:
        """The deepest node of every context of ``DEPTH`` symbols."""
        every = np.arange(SYMBOLS ** DEPTH, dtype=np.int32)
        out, base = np.zeros(len(every), np.int32), 0
        for d, keys in enumerate(self.nodes):
            if d:
                known = np.full(SYMBOLS ** d, -1, np.int32)
                known[keys] = base + np.arange(len(keys), dtype=np.int32)
                node = known[every % SYMBOLS ** d]
                out = np.where(node >= 0, node, out)
            base += len(keys)
        return out * SYMBOLS

    def order0(self, text: str) -> np.ndarray:
        """Bits that the whole text takes under each language without any context."""
        return np.bincount(symbols(text)[DEPTH:], minlength=SYMBOLS) @ self.bits[:SYMBOLS].astype(np.float64)

    def lengths(self, text: str, table: np.ndarray) -> np.ndarray:
        """Bits that the whole text takes under each language."""
        s, total = symbols(text), np.zeros(len(self.langs))
        for a in range(0, max(1, len(s) - DEPTH), SLICE):
            part = s[a:a + SLICE + DEPTH]
            if len(part) > DEPTH:
                at = table[grams(part[:-1], DEPTH)] + part[DEPTH:]
                total += self.bits[at].sum(axis=0, dtype=np.float64)
        return total

    def is_language(self, text: str, table: np.ndarray, bits: np.ndarray) -> bool:
        """Whether the text, or more than half of its words, code better than letter by
        letter; ``bits`` are the text's lengths."""
        if bits.min() < self.order0(text).min():
            return True
        words = [w for w in text.split() if has_letter(w)]
        best = bits.argmin()
        return 2 * sum(self.lengths(w, table)[best] < self.order0(w).min() for w in words) > len(words)


def _coded(seen: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities at some contexts: counts there, and escapes to ``shorter``
    shared among the symbols not seen there (exclusion)."""
    n, kinds = seen.sum(axis=1, keepdims=True), (seen > 0).sum(axis=1, keepdims=True)
    rest = np.where(seen > 0, 0, shorter)
    left = rest.sum(axis=1, keepdims=True)
    escapes = np.where(left > 0, kinds, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        known = np.where(seen > 0, seen / (n + escapes), escapes / (n + escapes) * rest / np.where(left > 0, left, 1))
    return np.where(n > 0, known, shorter)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", grams_kept: int = MODEL_GRAMS) -> Model:
    """A model from all rows of ``labelled`` with a language."""
    return _model(staged(count_grams(labelled, text_col, lang_col), "lang-counts"), grams_kept)


def _model(counts: DataFrame, grams_kept: int) -> Model:
    each = grams_kept // max(1, counts.select("lang").distinct().count())
    most = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = counts.withColumn("_r", F.row_number().over(most)).filter(F.col("_r") <= each).drop("_r")
    return Model(kept.toPandas())


class Halves:
    """The model of all labelled rows, and one of each half of them."""

    def __init__(self, labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", grams_kept: int = MODEL_GRAMS):
        self.text_col, self.lang_col = text_col, lang_col
        lang, half = F.col(lang_col), self.half().cast("string")
        rows = labelled.select(F.concat(half, lang).alias("lang"), F.col(text_col).alias("text"))
        n = {r["lang"]: r["count"] for r in rows.dropna().groupBy("lang").count().collect()}
        counts = staged(count_grams(rows, "text", "lang"), "lang-counts")
        named = counts.select(F.substring("lang", 1, 1).alias("half"), F.expr("substring(lang, 2)").alias("lang"), "gram", "n")
        everything = named.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        self.models = [_model(named.filter(F.col("half") == h).drop("half"), grams_kept) for h in "01"]
        self.models.append(_model(everything, grams_kept))
        self.known = [[k[1:] for k, rows in n.items() if k[0] == h and rows >= HALF_ROWS] for h in "01"]

    def half(self) -> Column:
        return F.pmod(F.xxhash64(ascii_lower(F.col(self.text_col))), F.lit(2))

    def judge(self) -> Column:
        """The number of the model that judges a row."""
        which = F.lit(2)
        for other, langs in enumerate(self.known):
            which = F.when((self.half() == 1 - other) & F.col(self.lang_col).isin(langs), other).otherwise(which)
        return which


def is_language(model: Model, spark):
    """A pandas UDF: text to struct(kept, score)."""
    shared = sent(spark.sparkContext, model)

    @F.pandas_udf("kept boolean, score double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, table = received(shared), None
        for texts in batches:
            rows = []
            for t in texts:
                if not t or not has_letter(t):
                    rows.append((False, 0.0))
                    continue
                if not m.langs:
                    rows.append((True, 1.0))
                    continue
                if table is None:
                    table = m.table()
                bits = m.lengths(t, table)
                rows.append((m.is_language(t, table, bits), _posterior(bits)))
            yield pd.DataFrame(rows, columns=["kept", "score"])

    return judged.asNondeterministic()


def _posterior(bits: np.ndarray) -> float:
    return float(1 / np.exp2(np.maximum(bits.min() - bits, -1000)).sum())


def scored(model: Model, spark):
    """A pandas UDF: text to struct(lang, score, bits), bits per byte of the text."""
    shared = sent(spark.sparkContext, model)

    @F.pandas_udf("lang string, score double, bits double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = received(shared)
        table = m.table() if m.langs else None
        for texts in batches:
            rows = []
            for t in texts:
                if not t or table is None or not has_letter(t):
                    rows.append((NOBODY, 0.0, None))
                    continue
                bits = m.lengths(t, table)
                best = int(bits.argmin())
                rows.append((m.langs[best], _posterior(bits),
                             float(bits[best]) / (len(t.encode("utf-8", "replace")) or 1)))
            yield pd.DataFrame(rows, columns=["lang", "score", "bits"])

    return score.asNondeterministic()


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred, score and bits_per_byte of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    got = rows.select("id", scored(model, docs.sparkSession)("text").alias("_g"))
    return got.select(F.col("id").alias(id_col), F.col("_g.lang").alias("lang_pred"),
                      F.col("_g.score").alias("score"), F.col("_g.bits").alias("bits_per_byte"))


def identified(docs: DataFrame, model: Model | Halves, text_col: str = "text", min_score: float = 0.0) -> DataFrame:
    """``docs`` without the rows in no language or of a lower score."""
    if not isinstance(model, Halves):
        return _kept(docs, model, text_col, min_score)
    which, out = model.judge(), None
    for k, m in enumerate(model.models):        # a task holds the one model of its rows
        part = _kept(docs.filter(which == k), m, text_col, min_score)
        out = part if out is None else out.unionByName(part)
    return out


def _kept(docs: DataFrame, model: Model, text_col: str, min_score: float) -> DataFrame:
    verdict = prefix(docs) + "verdict"
    got = docs.withColumn(verdict, is_language(model, docs.sparkSession)(F.col(text_col)))
    return got.filter(F.col(f"{verdict}.kept") & (F.col(f"{verdict}.score") >= min_score)).select(*docs.columns)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids are fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(n)), F.lit(0))
