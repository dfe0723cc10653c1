import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as hn

SCHEMA = "vec_id long, label string, embedding array<double>, id string, score int"


def brute(rows, every, positives=5, negatives=10, scale=256.0):
    use = sorted({(i, l, tuple(math.floor(scale * x) for x in v)) for i, l, v in rows
                  if i is not None and l is not None and v is not None
                  and all(x is not None and math.isfinite(x) for x in v)})
    cut = lambda s: min(max(s, -hn.LONG), hn.LONG)      # noqa: E731
    dot = lambda x, y: cut(sum(int(a) * int(b) for a, b in zip(x, y)))      # noqa: E731
    out = []
    for a, label, x in use:
        if a % every:
            continue
        pos = sorted({(-dot(x, v), i) for i, l, v in use if l == label and i != a})[:positives]
        other = sorted({(-dot(x, v), i) for i, l, v in use if l != label and i != a})
        for s, p in pos:
            fit = [(i, -t) for t, i in other if 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a, p, k, i, -s, t) for k, (i, t) in enumerate(fit, 1)]
    return sorted(out)


def mined(frame, rows, every, **more):
    df = frame([(*r, "x", 0) for r in rows], SCHEMA)
    out = hn.hard_negatives(df, F.col("id") % every == 0, **more)
    return sorted(tuple(r) for r in out.collect())


def random_rows(n, dims, seed, labels="abc"):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(5, dims))
    return [(i, labels[int(rnd.integers(len(labels)))], (centres[i % 5] + rnd.normal(size=dims) * 0.4).tolist()) for i in range(n)]


@pytest.fixture()
def small(monkeypatch):
    """Many rounds, groups and tiles on a few rows."""
    for name, value in (("FIRST_ROWS", 8), ("GROWTH", 3), ("GROUP_BYTES", 5000), ("TILE", (3, 16))):
        monkeypatch.setattr(hn, name, value)


def test_equals_brute_force(frame):
    rows = random_rows(300, 12, 1)
    assert mined(frame, rows, 40) == brute(rows, 40)


def test_rounds_groups_and_tiles(frame, small):
    rows = random_rows(160, 7, 2)
    got = mined(frame, rows, 16)
    assert got and got == brute(rows, 16)


def test_ties_and_repeated_rows(frame, small):
    rnd = random.Random(4)
    vectors = [[1.0, 0.5, 0.0], [0.9, 0.5, 0.1], [0.5, 0.25, 0.0], [0.0, 0.0, 0.0]]
    rows = [(i, rnd.choice("ab"), rnd.choice(vectors)) for i in range(60)]
    rows += [rows[0]] * 30 + [(0, "b", vectors[1])] * 10 + [(5, "a", vectors[2])]
    assert mined(frame, rows, 10) == brute(rows, 10)


def test_rows_that_take_no_part(frame):
    rows = random_rows(40, 4, 3)
    rows += [(None, "a", [1.0] * 4), (100, None, [1.0] * 4), (101, "a", None), (102, "a", [1.0, None, 0.0, 0.0]),
             (103, "b", [math.nan] * 4), (104, "b", [math.inf] * 4), (105, "b", []), (106, "b", [0.5]), (107, "a", [1.0] * 5)]
    assert mined(frame, rows, 10) == brute(rows, 10)


def test_wide_components(frame):
    rnd = np.random.default_rng(9)
    rows = [(i, "ab"[i % 2], (rnd.normal(size=3) * 10.0 ** rnd.integers(0, 12)).tolist()) for i in range(40)]
    rows += [(i, "ab"[i % 2], [3e38, -1e20, 0.5]) for i in range(40, 44)]
    assert mined(frame, rows, 4) == brute(rows, 4)


def test_empty_tables(frame):
    assert mined(frame, [], 10) == []
    assert mined(frame, [(3, "a", [1.0]), (4, "b", [1.0])], 10) == []
    assert mined(frame, [(10, "a", [1.0])], 10) == []


def test_bounds_hold_at_every_level():
    rnd = np.random.default_rng(5)
    q = np.floor(256 * rnd.normal(size=(50, 48)))
    q = np.pad(q, ((0, 0), (0, hn.width(48) - 48)))
    before = None
    for m, d in hn.levels(*hn.summary(q)):
        gap = d @ d.T
        assert (np.abs(q @ q.T - m @ m.T) <= gap + 1e-6 * np.abs(q @ q.T).max()).all()
        assert before is None or gap.sum() <= before + 1e-6
        before = gap.sum()


def test_filter_drops_pairs_before_exact_scores():
    q = np.floor(256 * np.array([[1.0, 1, 0, 0], [1, 1, 0, 0], [0, 0, 1, 1], [0, 0, .1, .1]]))
    side = {"id": np.arange(4), "label": np.array(list("abbb"), object), "levels": hn.levels(*hn.summary(q))}
    one = {k: v[:1] if k != "levels" else [(m[:1], d[:1]) for m, d in v] for k, v in side.items()}
    i, j = hn.survivors(one, side, False, np.array([60_000]), np.array([200_000]))
    assert list(j) == [1]
