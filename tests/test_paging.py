"""Deep pages equal the plain sort and never gather the rows before them."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import paging


@pytest.fixture()
def rows(spark):
    return spark.range(500).select("id", (F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") % 11).alias("v"))


@pytest.mark.parametrize("offset,limit", [(0, 5), (37, 10), (333, 40), (495, 20), (900, 5)])
def test_deep_equals_near(rows, monkeypatch, offset, limit):
    order = [F.col("k").desc_nulls_first(), F.col("v").asc_nulls_last(), F.col("id").asc()]
    near = [tuple(r) for r in paging.page_of(rows, order, offset, limit).collect()]
    monkeypatch.setattr(paging, "NEAR", 0)
    deep = paging.page_of(rows, order, offset, limit)
    assert deep.columns == rows.columns and [tuple(r) for r in deep.collect()] == near


def test_rows_that_tie_on_every_key_appear_once_each(spark, monkeypatch):
    monkeypatch.setattr(paging, "NEAR", 0)
    df = spark.range(100).select((F.col("id") % 2).alias("a"), F.lit("x").alias("b"))
    got = [r.a for p in range(10) for r in paging.page_of(df, [F.col("b").asc(), F.col("a").asc()], 10 * p, 10).collect()]
    assert got == [0] * 50 + [1] * 50


def test_plan_of_a_deep_page_has_no_top_k(rows, monkeypatch):
    monkeypatch.setattr(paging, "NEAR", 0)
    plan = paging.page_of(rows, [F.col("id").asc()], 400, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
