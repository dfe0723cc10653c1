"""The chart dispatcher: eight types, required keys, order of the rows."""

import pytest

from tessera_testing import SF
from tessera.catalog import Catalog
from tessera.operators import charts, timeprofile
from tessera.plans.chart_data import REQUIRED, ChartError, chart_data
from tessera.plans.view import compile_view

VIEW = {"from_tables": ["orders"], "columns": [{"table": "orders", "column": c} for c in (
    "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")]}
CONFIGS = {
    "table": {"visible_columns": ["o_orderkey", "o_totalprice"], "sort_column": "o_totalprice", "sort_direction": "desc"},
    "kpi_card": {"value_column": "o_totalprice", "label": "sum", "aggregation": "MAX"},
    "bar": {"x_column": "o_orderpriority", "y_columns": ["o_totalprice"], "group_by_column": "o_orderstatus"},
    "line": {"x_column": "o_orderdate", "y_columns": ["o_totalprice"], "time_granularity": "quarter"},
    "pie": {"label_column": "o_orderpriority", "value_column": "o_totalprice"},
    "scatter": {"x_column": "o_orderkey", "y_columns": ["o_totalprice"]},
    "histogram": {"columns": ["o_totalprice"], "bins": 7},
    "boxplot": {"category_column": "o_orderstatus", "value_column": "o_totalprice"},
}


@pytest.fixture(scope="module")
def cat(spark):
    return Catalog.from_dir(spark, SF)


@pytest.mark.parametrize("kind", sorted(REQUIRED))
def test_each_type(cat, kind):
    df = compile_view(cat, VIEW)
    want = {
        "table": lambda: charts.table_chart(df, ["o_orderkey", "o_totalprice"], "o_totalprice", "desc"),
        "kpi_card": lambda: charts.kpi(df, "o_totalprice", "MAX"),
        "bar": lambda: charts.bar(df, "o_orderpriority", ["o_totalprice"], "o_orderstatus"),
        "line": lambda: charts.line(df, "o_orderdate", ["o_totalprice"], granularity="quarter"),
        "pie": lambda: charts.pie(df, "o_orderpriority", "o_totalprice"),
        "scatter": lambda: charts.scatter_sampled(df, "o_orderkey", ["o_totalprice"]),
        "histogram": lambda: charts.histogram(df, ["o_totalprice"], 7),
        "boxplot": lambda: charts.boxplot(df, "o_totalprice", "o_orderstatus"),
    }[kind]()
    got = chart_data(cat, VIEW, kind, CONFIGS[kind])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    for key in REQUIRED[kind]:
        with pytest.raises(ChartError, match=key):
            chart_data(cat, VIEW, kind, {k: v for k, v in CONFIGS[kind].items() if k != key})


def test_rows_come_in_order(cat):
    for kind, key in (("bar", "o_orderpriority"), ("histogram", "bin")):
        rows = [r[key] for r in chart_data(cat, VIEW, kind, CONFIGS[kind]).collect()]
        assert rows == sorted(rows)


def test_time_profile_needs_a_date_column(cat):
    config = {**CONFIGS["table"], "visible_columns": ["o_orderdate", "o_totalprice"], "sort_column": None}
    plain = chart_data(cat, VIEW, "table", config, granularity="year").collect()
    assert len(plain) == charts.TABLE_PAGE_SIZE
    years = chart_data(cat, VIEW, "table", {**config, "date_column": "o_orderdate"}, granularity="year")
    want = timeprofile.rebucket(compile_view(cat, VIEW), "o_orderdate", "year", "SUM")
    assert years.count() == want.count() < charts.TABLE_PAGE_SIZE
    with pytest.raises(ChartError, match="unknown"):
        chart_data(cat, VIEW, "radar", {})
