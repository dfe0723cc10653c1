import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import decontam

ITEMS = "item_id long, text string"


def brute(words, items, least):
    hit, found = set(), set()
    for key, item in items:
        n = min(least, len(item))
        for i in range(len(item) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j:j + n] == item[i:i + n]:
                    hit.update(range(j, j + n))
                    found.add(key)
    return hit, found


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=9), max_size=5),
       st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=30), st.integers(1, 4))
def test_automaton_against_brute_force(items, words, least):
    keyed = list(enumerate(items))
    runs, found = decontam.Automaton([x for x in keyed if x[1]], least).scan(words)
    hit, want = brute(words, keyed, least)
    assert {i for b, e in runs for i in range(b, e)} == hit and found == want
    assert all(a[1] < b[0] for a, b in zip(runs, runs[1:]))


def cases():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["Été", "X1"]
    items = [(i, " ".join(rnd.choices(words, k=k))) for i, k in enumerate((30, 12, 10, 9, 2, 25, 10))]
    items += [(7, None), (8, " -- "), (9, items[0][1]), (None, items[1][1])]
    texts = [" ".join(rnd.choices(words, k=k)) for k in (0, 5, 60, 300)]
    texts += [f"{texts[1]} :: {t.upper()} - tail" for _, t in items if t] + [None, "", items[0][1] + " " + texts[3]]
    return [(i if i != 2 else None, t) for i, t in enumerate(texts)] + [(1, texts[1])], items


@pytest.mark.parametrize("block_words", [1 << 17, 40])
def test_contamination(docs, frame, block_words):
    pairs, items = cases()
    got = decontam.contamination(docs(pairs).withColumn("item_id", F.lit(1)), frame(items, ITEMS), block_words=block_words)
    want = []
    for i, t in pairs:
        words = decontam.words_of(t)
        hit, found = brute(words, [(k, decontam.words_of(x)) for k, x in items], 10)
        ids = sorted(str(k) for k in found if k is not None)
        want.append((i, len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_decontaminate(docs, frame):
    item = "one two three four five six seven eight nine ten eleven"
    pairs = [(1, f"Clean start of words here and there, {item.title()}; then a clean end of this one text."), (2, item),
             (3, "nothing to see"), (4, None), (5, ""), (6, "one two three four five " + "A b c d e f g h i j k l m. " * 2 + item),
             (7, f"one two three four five {item} six seven eight nine ten eleven p q r s t u v w x y z p q r s t u v w")]
    df = docs(pairs).withColumn("_x", F.lit(1))
    got = decontam.decontaminate(df, frame([(1, item)], ITEMS))
    rows = {r.doc_id: r.text for r in got.collect()}
    assert got.columns == df.columns
    assert rows[1] == "Clean start of words here and there, ; then a clean end of this one text."
    assert 2 not in rows and rows[3] == "nothing to see" and rows[4] is None and rows[5] == ""
    assert not decontam.contamination(got, frame([(1, item)], ITEMS)).filter("contaminated").count()


def test_empty_tables(docs, frame):
    assert decontam.contamination(docs([]), frame([(1, "a")], ITEMS)).count() == 0
    assert decontam.contamination(docs([(1, "a")]), frame([], ITEMS)).first().n_hit == 0
