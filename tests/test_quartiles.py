"""Quartiles by narrowing equal numpy's, whatever the shape of the data, and without a full sort."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import charts as G

SHAPES = {"one": [5.0], "two": [1.0, 9.0], "three": [1.0, 2.0, 9.0], "tied": [3.0] * 500 + [4.0], "wide": [-1e300, 0.0, 1e300],
          "even": list(range(1000)), "skew": [0.0] * 700 + [float(x) for x in np.random.default_rng(1).pareto(1, 3000)]}


def frame(spark):
    return spark.createDataFrame([(k, float(v)) for k, vs in SHAPES.items() for v in vs], "category string, value double")


@pytest.mark.parametrize("accuracy", [100_000, 20])
def test_equal_numpy(spark, monkeypatch, accuracy):
    monkeypatch.setattr(G, "SKETCH", accuracy)      # a coarse sketch misses, and the full ranking steps in
    got = {r.category: (r["count"], r.q1, r.median, r.q3) for r in G._quartiles(frame(spark)).collect()}
    for k, vs in SHAPES.items():
        assert got[k][0] == len(vs) and got[k][1:] == pytest.approx(tuple(np.quantile(vs, [.25, .5, .75])), rel=1e-12), k


def test_only_values_near_a_quartile_move(spark):
    vals = spark.range(200_000).select(F.lit("a").alias("category"), (F.xxhash64("id") % 1_000_003).cast("double").alias("value"))
    b = G._brackets(vals).first()
    inside = vals.filter(" OR ".join(f"value BETWEEN {b[f'__{n}_low']} AND {b[f'__{n}_high']}" for n, _ in G.QUARTILES)).count()
    assert 3 <= inside < 200_000 * 0.002
    got = G._quartiles(vals).first()
    want = np.quantile([r.value for r in vals.collect()], [.25, .5, .75])
    assert (got.q1, got.median, got.q3) == pytest.approx(tuple(want))


def test_empty(spark):
    assert G._quartiles(frame(spark).filter("false")).count() == 0
