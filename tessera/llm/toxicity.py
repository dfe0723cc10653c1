"""Toxicity with noisy-channel deobfuscation (operator 4).

1. *Language model.* A context tree over the bytes of all documents (counts
   grow with the corpus; labels play no part) says how many bits a letter takes
   after the three before it.
2. *Channel.* A word that may be disguised (digits or signs among letters, a
   letter three times in a row, letters set apart) is a lattice: every sign may
   stand for some letters, for itself or for nothing, every long run for one or
   two letters. Viterbi search takes the path of fewest bits under channel and
   language model together. Other words are their own best path.
3. *Score of the restored text.* Words and their first letters are weighed by
   how much more often labelled toxic texts have them. The weights of a text's
   strongest words enter a logistic regression, fitted on labelled texts that
   played no part in the weights.

The classifier is fitted on ``TRAIN_ROWS`` labelled rows at most, those of
smallest hash of the id: a few hundred kilobytes, which is what is broadcast to
find their texts. Scoring shuffles nothing, so no key can be hot.

Defined results. Null and empty texts score as texts without any telling word.
Rows without a label, with null in id or label, train nothing; an id labelled
twice takes the larger label. With no label, or one kind only, every score is
the share of toxic labels (0 without any). Repeated rows give repeated results;
extra columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import lang_id
from tessera.llm.common import staged
from tessera.llm.lang_id import CLASS, DEPTH, SYMBOLS
from tessera.llm.workers import received, sent

TRAIN_ROWS = 40_000
LEXICON = 20_000            # telling words and beginnings kept
BEGINNINGS = range(3, 9)    # letters of a word's beginning
STRONGEST = 5               # words of a text that enter the regression
MEMO = 1 << 18
# Letters that signs stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "il", "+": "t", "|": "il", "€": "e", "£": "l", "*": "aeiou"}
SIGN_BITS, KEEP_BITS, DROP_BITS, ONE_BITS, TWO_BITS, RUN_BITS = 1.0, 9.0, 8.0, 1.0, 2.0, 6.0
JOIN_BITS, SPACE_BITS = 0.5, 4.0
GAP = "\x1f"      # between letters that are set apart
TOKEN = re.compile(r"[\w@$!+|€£*]+")
APART = re.compile(r"(?<![\w@$!+|€£*])(?:[\w@$!+|€£*][ .\-_·]{1,2}){3,}[\w@$!+|€£*](?![\w@$!+|€£*])")
EDGES = re.compile(r"^(?:([$@+|*])\1\1+|[!*+|_]+)+|(?:([$@+|*])\2\2+|[!*+|_]+)+$")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
RUN = re.compile(r"(.)\1*", re.S)
MASK = SYMBOLS ** (DEPTH - 1)


class Restorer:
    """Decodes disguised words; one per task."""

    def __init__(self, model: lang_id.Model):
        self.known = bool(model.langs)
        if self.known:
            self.bits, self.table = model.bits[:, 0], model.table()
        self.memo: dict[str, tuple[str, ...]] = {}

    def _spell(self, state: tuple, letters: str, cost: float) -> tuple:
        bits, context, out = state
        for s in letters.encode("utf-8", "replace").translate(CLASS):
            bits += float(self.bits[self.table[context] + s])
            context = context % MASK * SYMBOLS + s
        return bits + cost, context, out + letters

    @staticmethod
    def arcs(char: str, n: int) -> list[tuple[str, float]]:
        """What a run of ``n`` equal characters may stand for, and the bits that takes."""
        if char == GAP:
            return [("", JOIN_BITS), (" ", SPACE_BITS)]
        if char.isalpha():
            return [(char * n, 0.0)] if n < 3 else [(char, ONE_BITS), (char * 2, TWO_BITS), (char * n, RUN_BITS)]
        out = [(" ", KEEP_BITS)]
        for letter in LEET.get(char, ""):
            out.append((letter, SIGN_BITS + ONE_BITS * (n > 1)))
            if n > 1:
                out.append((letter * 2, SIGN_BITS * 2))
        if not char.isdigit():
            out.append(("", DROP_BITS))
        return out

    def decode(self, token: str) -> str:
        """The most likely clean spelling of a disguised word."""
        best = {0: (0.0, 0, "")}
        for m in RUN.finditer(token):
            arcs, after = self.arcs(m[1], len(m[0])), {}
            for state in best.values():
                for letters, cost in arcs:
                    new = self._spell(state, letters, cost)
                    old = after.get(new[1])
                    if old is None or new[0] < old[0]:
                        after[new[1]] = new
            best = after
        return min(self._spell(s, " ", 0.0) for s in best.values())[2]

    def restored(self, token: str) -> tuple[str, ...]:
        """The words that a token stands for."""
        got = self.memo.get(token)
        if got is None:
            core = EDGES.sub("", token)
            if core.isalpha() and not TRIPLE.search(core) or not self.known:
                got = (core,) if core.isalpha() else ()
            elif not any(c.isalpha() for c in core):
                got = ()
            else:
                got = tuple(self.decode(core).split())
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[token] = got
        return got

    def words(self, text: str | None) -> set[str]:
        """The distinct words of the restored text."""
        if not text:
            return set()
        lower = text.lower()
        out: set[str] = set()
        tokens = TOKEN.findall(lower)
        # Only where four tokens of one character follow each other can letters be set apart.
        if b"\1\1\1\1" in bytes([len(t) == 1 for t in tokens]) or "_" in lower:
            for m in APART.findall(lower):
                out.update(self.restored(GAP.join(TOKEN.findall(m))))
        for token in set(tokens):
            out.update(self.restored(token))
        return out


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in BEGINNINGS if n < len(word))]


class Lexicon(dict):
    """Feature to weight; the weight of a word is that of its strongest feature."""

    def strongest(self, words: set[str], memo: dict[str, float]) -> list[float]:
        found = []
        for w in words:
            v = memo.get(w)
            if v is None:
                v = max((self.get(f, 0.0) for f in features(w)), default=0.0)
                if len(memo) >= MEMO:
                    memo.clear()
                memo[w] = v
            if v > 0:
                found.append(v)
        found = sorted(found, reverse=True)[:STRONGEST]
        return found + [0.0] * (STRONGEST - len(found))


def weighed(counts: pd.DataFrame, n0: int, n1: int) -> Lexicon:
    """Log odds of features, from how many clean (c0) and toxic (c1) texts have them."""
    if not n0 or not n1:
        return Lexicon()
    c0, c1 = counts["c0"].to_numpy(float), counts["c1"].to_numpy(float)
    p = (c0 + c1) / (n0 + n1)
    z = (c1 / n1 - c0 / n0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + 1e-12)
    odds = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
    top = np.argsort(-z, kind="stable")[:LEXICON]
    top = top[(z[top] > 4) & (c1[top] >= 3) & (odds[top] > 0)]
    return Lexicon(zip(counts["feature"].to_numpy()[top].tolist(), odds[top].tolist()))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic regression with intercept, by Newton's method."""
    x = np.column_stack((np.ones(len(x)), x))
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def sampled(labels: DataFrame, id_col: str, label_col: str, rows: int) -> DataFrame:
    """At most ``rows`` labels, those whose ids have the smallest hashes."""
    clean = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    return clean.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)


class Scorer:
    def __init__(self, model: lang_id.Model, lexicon: Lexicon, weights: np.ndarray | None, share: float):
        self.model, self.lexicon, self.weights, self.share = model, lexicon, weights, share


def _counter(asked):
    """Counts in how many texts each feature is; with ``asked``, of those features."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            return pd.DataFrame({"feature": pd.Series(list(seen), dtype=object), "n": list(seen.values())})

        seen: Counter = Counter()
        for b in batches:
            for words in b["words"]:
                found = {f for w in words for f in features(w)}
                seen.update(found if asked is None else found & asked.value)
                if len(seen) > 50_000:
                    yield rows()
                    seen = Counter()
        yield rows()

    return count


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Scorer:
    """Language model from all ``docs``, classifier from the texts of ``labels``."""
    spark = docs.sparkSession
    counts = lang_id.count_grams(docs.select(F.col(text_col).alias("text"), F.lit("all").alias("lang")), "text", "lang")
    model = lang_id.Model(counts.orderBy(F.desc("n"), "gram").limit(lang_id.MODEL_GRAMS).toPandas())
    shared = sent(spark.sparkContext, model)
    chosen = F.broadcast(sampled(labels, id_col, label_col, train_rows))     # at most train_rows short rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(received(shared))
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "words": [sorted(restorer.words(t)) for t in b["text"]]})

    train = staged(texts.join(chosen, "id").select(
        "text", F.when(F.col("label") > 0, 1).otherwise(0).alias("label"), F.pmod(F.xxhash64("id"), F.lit(4)).alias("fold"))
        .withColumn("label", F.col("label") + 2 * (F.col("fold") == 0).cast("int"))
        .mapInPandas(read, "label int, words array<string>"), "toxic-train")       # labels 2 and 3: for the regression

    n = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
    toxic = (train.filter("label = 1").mapInPandas(_counter(None), "feature string, n long").groupBy("feature")
             .agg(F.sum("n").alias("c1")).filter("c1 >= 3").orderBy(F.desc("c1"), "feature").limit(10 * LEXICON).toPandas())
    asked = spark.sparkContext.broadcast(frozenset(toxic["feature"]))       # only these are counted in clean texts
    clean = (train.filter("label = 0").mapInPandas(_counter(asked), "feature string, n long").groupBy("feature")
             .agg(F.sum("n").alias("c0")).toPandas())
    lexicon = weighed(toxic.merge(clean, "left", "feature").fillna({"c0": 0}), n.get(0, 0), n.get(1, 0))
    known = sent(spark.sparkContext, lexicon)

    def strongest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, memo = received(known), {}
        for b in batches:
            yield pd.DataFrame({"label": b["label"] - 2, "x": [words.strongest(w, memo) for w in b["words"]]})

    rows = train.filter("label >= 2").mapInPandas(strongest, "label int, x array<double>").toPandas()
    total = sum(n.values())
    share = (n.get(1, 0) + n.get(3, 0)) / total if total else 0.0
    weights = None
    if rows["label"].nunique() == 2:
        weights = logistic(np.array(rows["x"].tolist(), float), rows["label"].to_numpy(float))
    return Scorer(model, lexicon, weights, share)


def scored(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text",
           threshold: float = 0.3) -> DataFrame:
    """``id_col``, score, predicted and the number of telling words, of every row."""
    shared = sent(docs.sparkSession.sparkContext, scorer)

    @F.pandas_udf("score double, n_words int")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        s = received(shared)
        restorer, memo = Restorer(s.model), {}
        for texts in batches:
            x = np.array([s.lexicon.strongest(restorer.words(t), memo) for t in texts], float).reshape(-1, STRONGEST)
            score = np.full(len(x), s.share)
            if s.weights is not None:
                score = 1 / (1 + np.exp(-np.clip(s.weights[0] + x @ s.weights[1:], -30, 30)))
            yield pd.DataFrame({"score": score, "n_words": (x > 0).sum(axis=1).astype(np.int32)})

    got = docs.select(F.col(id_col).alias("id"), judge.asNondeterministic()(F.col(text_col)).alias("_g"))
    return got.select(F.col("id").alias(id_col), F.col("_g.score").alias("score"),
                      F.when(F.col("_g.score") >= threshold, 1).otherwise(0).alias("predicted"),
                      F.col("_g.n_words").alias("n_telling"))


def restore_words(docs: DataFrame, model: lang_id.Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the distinct words of the restored text."""
    shared = sent(docs.sparkSession.sparkContext, model)

    @F.pandas_udf("array<string>")
    def words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer(received(shared))
        for texts in batches:
            yield pd.Series([sorted(restorer.words(t)) for t in texts])

    return docs.select(F.col(id_col), words.asNondeterministic()(F.col(text_col)).alias("words"))
