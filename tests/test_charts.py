"""Chart transforms: fixture values of the original plus brute-force checks."""

import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.ranking import POS, SIZE, positions
from tessera.operators import charts as G
from tessera.operators.timeprofile import preset_range


def test_kpi_tile_fixture(spark):
    df = spark.createDataFrame([("10",), ("20.5",), (None,), ("5",)], "amount string")
    got = {m: G.kpi_tile(df, "amount", m).first()["value"]
           for m in ("SUM", "AVG", "COUNT", "MIN", "MAX")}
    assert got["SUM"] == 35.5 and math.isclose(got["AVG"], 35.5 / 3)
    assert (got["COUNT"], got["MIN"], got["MAX"]) == (4, 5, 20.5)
    txt = spark.createDataFrame([("abc",)], "s string")
    assert G.kpi_tile(txt, "s", "SUM").first()["value"] is None


def test_kpi_card_null_as_zero(spark):
    df = spark.createDataFrame([(10.0,), (None,), (4.0,)], "v double")
    assert G.kpi(df, "v", "AVG").first()["value"] == 14.0 / 3
    assert G.kpi(df, "v", "MIN").first()["value"] == 0.0
    assert G.kpi(df, "v", "COUNT").first()["value"] == 3


def test_date_presets_fixture():
    today = dt.date(2026, 8, 11)
    assert preset_range("last7", today) == (dt.date(2026, 8, 5), today)
    assert preset_range("last30", today) == (dt.date(2026, 7, 13), today)
    assert preset_range("thisMonth", today) == (dt.date(2026, 8, 1), today)
    assert preset_range("thisYear", today) == (dt.date(2026, 1, 1), today)
    assert preset_range("last3months", dt.date(2026, 3, 10)) == (dt.date(2025, 12, 10),
                                                                 dt.date(2026, 3, 10))
    # a calendar widget rolls 31 May - 3 months into March
    assert preset_range("last3months", dt.date(2026, 5, 31))[0] == dt.date(2026, 3, 3)


def test_positions_exact_under_skew(spark):
    random.seed(7)
    rows = [("hot", float(random.randint(0, 50))) for _ in range(3000)] + \
           [(f"c{i % 7}", float(random.randint(0, 9))) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = positions(df, ["g"], [F.col("v")], num_partitions=8).collect()
    by = {}
    for r in out:
        by.setdefault(r["g"], []).append((r[POS], r["v"], r[SIZE]))
    for g, lst in by.items():
        lst.sort()
        assert [p for p, _, _ in lst] == list(range(len(lst)))
        assert [v for _, v, _ in lst] == sorted(v for _, v, _ in lst)
        assert all(n == len(lst) for _, _, n in lst)


def test_boxplot_matches_numpy(spark):
    random.seed(3)
    vals = [random.expovariate(0.1) for _ in range(2000)]
    df = spark.createDataFrame([("a" if i % 3 else "b", v) for i, v in enumerate(vals)],
                               "cat string, v double")
    got = {r["category"]: r for r in G.boxplot(df, "v", "cat").collect()}
    for cat, sel in (("a", [v for i, v in enumerate(vals) if i % 3]),
                     ("b", [v for i, v in enumerate(vals) if not i % 3])):
        q1, med, q3 = np.quantile(sel, [0.25, 0.5, 0.75])
        r = got[cat]
        assert r["count"] == len(sel)
        assert math.isclose(r["q1"], q1) and math.isclose(r["median"], med)
        assert math.isclose(r["q3"], q3)
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inl = [v for v in sel if lo <= v <= hi]
        assert r["whisker_low"] == min(inl) and r["whisker_high"] == max(inl)
    outs = G.boxplot_outliers(df, "v", "cat").count()
    assert outs > 0


def test_stride_sample_matches_brute_force(spark):
    n = 4321
    df = spark.createDataFrame([(float(i), float(i % 17)) for i in range(n)], "x double, y double")
    pts = G.scatter(df, "x", ["y"])
    got = sorted(r["x"] for r in G.stride_sample(pts, ["series", "category"],
                                                  [F.col("x"), F.col("y")]).collect())
    stride = n / 2000
    want = sorted(float(math.floor(i * stride)) for i in range(2000))
    assert got == want


def test_histogram_edges(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "v double")
    h = G.histogram(df, ["v"], 2).orderBy("bin").collect()
    assert [r["v"] for r in h] == [1, 2]                 # max lands in the last bin
    same = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    h2 = G.histogram(same, ["v"], 4).orderBy("bin").collect()
    assert h2[0]["bin_start"] == 4.5 and h2[-1]["bin_end"] == 5.5
    assert sum(r["v"] for r in h2) == 2 and len(h2) == 4


def test_top_categories_and_pie_tail(spark):
    rows = [(f"k{i:02d}", 1.0) for i in range(12) for _ in range(12 - i)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    limited, cats = G.limit_categories(df, "k")
    assert cats[-1] == "其他" and len(cats) == 11
    pie = {r["name"]: r["value"] for r in G.pie(df, "k", "v", "SUM").collect()}
    assert len(pie) == 9 and pie["其他"] == 4 + 3 + 2 + 1 + 1
    share = G.pie_share(G.pie(df, "k", "v", "SUM"), hidden=("其他",)).collect()
    assert math.isclose(sum(r["share"] for r in share), 100, abs_tol=0.5)


def test_kpi_change_feb29(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 3, 1), 50.0), (dt.datetime(2024, 2, 28), 80.0),
                                (dt.datetime(2024, 2, 29), 100.0)], "d timestamp_ntz, v double")
    r = G.kpi_change(df, "v", "SUM", "d", "day").first()
    assert r["period"] == "2024-02-29" and r["prev_change"] == 25.0
    assert r["year_ago_change"] == 100.0                  # compared with 2023-03-01


def test_column_kinds(spark):
    df = spark.createDataFrame([("1", "2024-01-01", "a", 1.0)], "n string, d string, t string, x double")
    kinds = {r["column"]: r["kind"] for r in G.column_kinds(df).collect()}
    assert kinds == {"n": "number", "d": "date", "t": "text", "x": "number"}
