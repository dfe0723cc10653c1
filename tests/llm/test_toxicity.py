import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import lang_id, toxicity
from tessera.llm.common import table

LABELS = "doc_id long, quality int, toxic int"
CORPUS = ["you are an idiot and a moron, stupid loser", "the trash is worthless and pathetic", "a disgusting clown is here"] * 3


def model_of(texts):
    grams = np.concatenate([lang_id.grams(lang_id.symbols(t), lang_id.DEPTH + 1) for t in texts])
    g, n = np.unique(grams, return_counts=True)
    return lang_id.Model(pd.DataFrame({"lang": "all", "gram": g, "n": n}))


@pytest.fixture(scope="module")
def restorer():
    return toxicity.Restorer(model_of(CORPUS))


@pytest.mark.parametrize("seen,meant", [
    ("1d10t", "idiot"), ("stuuupid", "stupid"), ("w0rthl3ss", "worthless"), ("m0r0n$$$", "moron"), ("$tup!d", "stupid"),
    ("p@th3t1c", "pathetic"), ("clown!!", "clown"), ("1000", ""), ("plain", "plain"), ("###", ""), ("été", "été")])
def test_restored_words(restorer, seen, meant):
    assert " ".join(restorer.restored(seen)) == meant


def test_letters_set_apart(restorer):
    assert {"idiot", "stupid", "moron", "you"} <= restorer.words("You i.d.i.o.t, s t u p 1 d and a M-O-R-O-N")


def test_viterbi_against_all_paths(restorer):
    for token in ("1d10t", "l00ser", "sssc", "a1", "x!y"):
        runs = [m[1] * len(m[0]) for m in toxicity.RUN.finditer(token)]
        paths = itertools.product(*[restorer.arcs(r[0], len(r)) for r in runs])
        best = min((restorer._spell((sum(c for _, c in p), 0, ""), "".join(x for x, _ in p) + " ", 0.0) for p in paths))
        got = restorer.decode(token)
        assert restorer._spell((0.0, 0, ""), got, 0.0)[0] <= best[0] + 1e-6 and best[2] == got


def test_logistic_separates():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(500, 2))
    y = (x[:, 0] + 0.3 * rnd.normal(size=500) > 0.5).astype(float)
    w = toxicity.logistic(x, y)
    assert ((1 / (1 + np.exp(-(w[0] + x @ w[1:]))) > 0.5) == y).mean() > 0.9


def auc(score, label):
    rank, n1 = score.rank(), (label == 1).sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.1"
    docs = table(spark, sf, "documents").filter("doc_id < 4000")
    labels = table(spark, sf, "labels").filter("doc_id < 4000")
    held = lang_id.fold("doc_id", 4) == 2
    got = toxicity.scored(docs, toxicity.fit(docs, labels.filter(~held))).filter(held).join(labels, "doc_id").toPandas()
    assert len(got) > 300 and auc(got["score"], got["toxic"]) > 0.85


def test_cases(docs, frame):
    good, bad = "the quiet day went on and on here", "what an idiot and moron you are"
    pairs = [(i, f"{bad if i % 3 == 0 else good} {i}") for i in range(120)]
    pairs += [(200, None), (201, ""), (None, "an 1d10t"), (202, "x" * 50_000 + " st.u.p.i.d idiot m0ron"), (203, good), (203, good)]
    df = docs(pairs).withColumn("score", F.lit("mine"))
    labels = frame([(i, 0, int(i % 3 == 0)) for i in range(120)] + [(None, 0, 1), (5, 0, None), (0, 0, 0)], LABELS)
    got = {r.doc_id: r for r in toxicity.scored(df, toxicity.fit(df, labels)).collect()}
    assert len(got) == 125
    assert got[0].predicted == 1 and got[1].predicted == 0 and got[None].score > got[203].score
    assert got[202].predicted == 1 and got[200].predicted == 0 and got[201].score == got[200].score
    none = toxicity.scored(df, toxicity.fit(df, labels.filter("false")))
    assert {(r.score, r.predicted) for r in none.collect()} == {(0.0, 0)}
    assert toxicity.scored(docs([]), toxicity.fit(docs([]), labels)).count() == 0
