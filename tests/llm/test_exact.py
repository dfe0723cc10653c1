import hashlib

from pyspark.sql import functions as F

from tessera.llm import exact

UP = {c: c + 32 for c in range(65, 91)}


def brute(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault((t or "").translate(UP), []).append(i)
    out = []
    for i, t in pairs:
        n = (t or "").translate(UP)
        ids = [x for x in groups[n] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


LONG = "Some words about each Cat and dog here. " * 700
PAIRS = [(1, "Abc"), (2, "aBC"), (3, "ÀBC"), (4, "àbc"), (5, None), (6, ""), (7, "x"), (7, "X"), (None, "abc"), (8, LONG),
         (9, LONG.upper()), (10, LONG + "!"), (11, LONG[1:]), (12, "y" * 20_000), (13, "y" * 20_000), (None, "q")]


def test_against_brute_force(docs):
    got = exact.exact_duplicates(docs(PAIRS)).collect()
    assert sorted(map(tuple, got), key=str) == brute(PAIRS)


def test_colliding_hash_is_told_apart(docs):
    weak = lambda c: F.pmod(F.xxhash64(c), F.lit(3))
    got = exact.exact_duplicates(docs(PAIRS), chunk_hash=weak).collect()
    assert sorted(map(tuple, got), key=str) == brute(PAIRS)


def test_recipes_cover_the_text_and_resynchronise(docs):
    df = docs([(1, LONG), (2, "A new beginning. " + LONG)])
    a, b = (set(r.recipe) for r in exact.recipes(df).orderBy("id").collect())
    assert len(a & b) > 0.5 * len(a)


def test_dedup_keeps_rows_and_columns(docs):
    df = docs(PAIRS).withColumn("keep_id", F.lit("mine"))
    kept = exact.dedup(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)[:0] == []
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([2, 3, 4, 6, 7, 9, 10, 11, 13, None], key=str)
    assert exact.dedup(docs([])).count() == 0
