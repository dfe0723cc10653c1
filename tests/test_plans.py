"""Plan-level guarantees for every registered query (planning only)."""

import pytest

from tessera_testing import SF
from tessera.queries import registry

FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython",
             "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for name, (fn, _sql) in registry().items():
        out[name] = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
    return out


def test_no_cross_joins_or_python_nodes(plans):
    bad = {n: [f for f in FORBIDDEN if f in p] for n, p in plans.items()}
    assert {n: f for n, f in bad.items() if f} == {}


def test_flagship_prunes_and_pushes_down(plans):
    p = plans["v_flagship"]
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in p


def test_sorted_caps_are_top_k(plans):
    for n in ("v_sort_limit", "v_top_groups", "v_preview"):
        assert "TakeOrderedAndProject" in plans[n], n
