import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import repeats
from tessera.llm.common import table

SF = "/root/testdata/sf0.01"


def brute(pairs, length):
    raws = [(i, (t or "").encode()) for i, t in pairs]
    seen = Counter(r[k:k + length] for _, r in raws for k in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        runs = repeats.merged(*zip(*[(k, k + length) for k in range(len(r) - length + 1)
                                     if seen[r[k:k + length]] > 1] or [(0, 0)]))
        runs = [x for x in runs if x[1] > x[0]]
        gone = {p for a, b in runs for p in range(a, b)}
        kept = bytes(c for p, c in enumerate(r) if p not in gone)
        out.append((i, len(r), len(gone), len(runs), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(rnd, n, alphabet, most):
    base = ["".join(rnd.choices(alphabet, k=rnd.randrange(most))) for _ in range(n // 2)]
    out = list(base)
    while len(out) < n:
        a, b = rnd.choice(base), rnd.choice(base)
        i, j = sorted((rnd.randrange(len(a) + 1), rnd.randrange(len(a) + 1)))
        out.append(b[:rnd.randrange(len(b) + 1)] + a[i:j] + rnd.choice(["", "é", "x" * 70, a[:20]]))
    return out


@pytest.mark.parametrize("length,span,alphabet", [(24, 16, "abcdefghijkl "), (20, 16, "ab"), (70, 64, "aé"), (100, 16, "abcd")])
def test_against_brute_force(docs, length, span, alphabet):
    rnd = random.Random(length)
    pairs = [(i if i % 9 else None, t) for i, t in enumerate(texts(rnd, 60, alphabet, 260))]
    pairs += [(100, None), (101, ""), (102, "z" * 300), (103, pairs[3][1]), (103, pairs[3][1]), (104, "ab" * 90),
              (105, "q" * (length - 1)), (106, "q" * (length - 1)), (107, "r" * length)]
    df = docs(pairs).withColumn("row", F.lit("mine"))
    got = repeats.without_repeats(df, length=length, span=span, bytes_too=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(pairs, length)
    for r in got:
        assert r.kept is None or hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_long_texts_in_pieces(docs, monkeypatch):
    rnd = random.Random(8)
    monkeypatch.setattr(repeats, "BUFFER", 512)
    a = "".join(rnd.choices("abcdefgh", k=3000))
    pairs = [(1, a), (2, a[700:2500] + "x" + a[2501:]), (3, "".join(rnd.choices("abcdefgh", k=2000)))]
    assert sorted(map(tuple, repeats.without_repeats(docs(pairs), length=100, span=64).collect()), key=str) == brute(pairs, 100)


def test_anchor_hash_is_a_function_of_the_window():
    finder = repeats.Anchors(40, 16)
    rnd = np.random.default_rng(3)
    raw = rnd.integers(97, 100, 3000).astype(np.uint8)
    raw[2000:2500] = raw[100:600]
    with np.errstate(over="ignore"):
        t, a, first, last, h = finder.find(raw, np.array([0]), np.array([3000]))
    anchor = {w: (x - w, g) for x, f, e, g in zip(a, first, last, h) for w in range(f, e + 1)}
    assert len(anchor) == 3000 - 40 + 1
    assert all(anchor[100 + k] == anchor[2000 + k] for k in range(460))


def test_given_documents(spark):
    df = table(spark, SF, "documents")
    pairs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(tuple, repeats.without_repeats(df).collect()), key=str) == brute(pairs, repeats.LENGTH)


def test_empty_table(docs):
    assert repeats.without_repeats(docs([])).count() == 0
