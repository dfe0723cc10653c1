import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import graph, minhash

UP = {c: c + 32 for c in range(65, 91)}


def sets_of(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(UP)) if w]
    n = min(k, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def brute(pairs, k, threshold=80):
    sets = [sets_of(t, k) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= threshold * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(pairs):
        ids = [pairs[j][0] for j in range(len(pairs)) if find(j) == find(i) and pairs[j][0] is not None]
        comp = key if not sets[i] else min(ids) if ids else None
        out.append((key, len(sets[i]), comp, key == comp))
    return sorted(out, key=str)


def pairs_of(rnd, groups, copies, words=60, edits=2):
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(groups):
        base = rnd.choices(vocab, k=rnd.randrange(8, words))
        for _ in range(copies):
            t = list(base)
            for _ in range(rnd.randrange(edits + 1)):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            texts.append(" ".join(w.upper() if rnd.random() < .1 else w for w in t))
    return texts


@pytest.mark.parametrize("k", [4, 5])
def test_against_brute_force(docs, k):
    rnd = random.Random(k)
    texts = pairs_of(rnd, 12, 8) + ["a b c", "A  B\tc", "a", "b", "", None, " \n ", "a b c d", "x y z q r", "x y z q r"]
    pairs = [(i * 7 % 211, t) for i, t in enumerate(texts)]
    pairs += [(None, texts[0]), (None, "only null ids here now ok"), (500, texts[5]), (500, texts[5]), (501, "one " * 5000)]
    df = docs(pairs).withColumn("node", F.lit(1))
    got = sorted(map(tuple, minhash.near_duplicates(df, words=k).collect()), key=str)
    assert got == brute(pairs, k)
    kept = minhash.dedup(df, words=k)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted({g[0] for g in got if g[3] and g[0] is not None} | {None for g in got if g[0] is None and g[3]}, key=str)


def test_one_large_group_of_near_copies(docs):
    texts = pairs_of(random.Random(9), 1, 90, words=58, edits=5)
    pairs = list(enumerate(texts))
    assert sorted(map(tuple, minhash.near_duplicates(docs(pairs), words=4).collect()), key=str) == brute(pairs, 4)


def family(rnd, copies, base, most):
    """Copies of a text of ``base`` words with up to ``most`` new, lost or added words."""
    words, out = [f"w{i}" for i in range(base)], []
    for _ in range(copies):
        t = list(words)
        for _ in range(rnd.randrange(most + 1)):
            at, how = rnd.randrange(len(t)), rnd.random()
            t[at:at + (how < .8)] = [] if how < .3 else [f"x{rnd.randrange(3000)}"]
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("large,seed,threshold", [(2, 1, 80), (4, 4, 90)])
def test_differences_from_hubs_against_brute_force(docs, monkeypatch, large, seed, threshold):
    monkeypatch.setattr(minhash, "LARGE", large)
    monkeypatch.setattr(minhash, "EASY", 0 if seed % 2 else 1 << 40)       # with and without chains
    rnd = random.Random(seed)
    texts = [t for base in (40, 47, 90) for t in family(rnd, 70, base, 16)] + pairs_of(rnd, 6, 12, words=50, edits=6)
    pairs = list(enumerate(texts)) + [(None, texts[3])]
    got = minhash.near_duplicates(docs(pairs), words=4, threshold=threshold).collect()
    assert sorted(map(tuple, got), key=str) == brute(pairs, 4, threshold)


def test_pairs_made_do_not_grow_with_the_square_of_a_group(docs, monkeypatch):
    made, verified = [], minhash._verified

    def counted(pairs, *others):
        made.append(pairs.count())
        return verified(pairs, *others)

    monkeypatch.setattr(minhash, "_verified", counted)
    texts = family(random.Random(6), 400, 150, 14)
    pairs = list(enumerate(texts))
    assert sorted(map(tuple, minhash.near_duplicates(docs(pairs), words=4).collect()), key=str) == brute(pairs, 4)
    assert sum(made) < 12 * len(texts), made


def test_minima_estimate_similarity():
    rnd = np.random.default_rng(2)
    with np.errstate(over="ignore"):
        both, a, b = (minhash.mixed(rnd.integers(0, 1 << 63, n).astype(np.uint64)) for n in (800, 100, 100))
        x, y = (np.unique(np.concatenate((both, o))) for o in (a, b))
        sx, sy = minhash.signature(x), minhash.signature(y)
    assert abs((sx == sy).mean() - 0.8) < 0.1
    apart = sum(int(v).bit_count() for v in (minhash.sketch(sx) ^ minhash.sketch(sy)).view(np.uint64))
    assert apart <= minhash.BITS
    assert np.array_equal(minhash.signature(x), np.concatenate([minhash.signature(x)]))


def test_components_against_union(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)]
    edges += [(5000, 5001 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for u, v in edges if u != v for x in (u, v)}
    assert got == {x: find(x) for x in linked}


def test_empty_table(docs):
    assert minhash.near_duplicates(docs([])).count() == 0
    assert minhash.dedup(docs([])).count() == 0
