"""Every registered query against its DuckDB oracle on sf0.001."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import TABLES, rows_of  # noqa: E402
from tessera.queries import registry  # noqa: E402

SF = "/root/testdata/sf0.001"
OWN = registry()
NAMES = sorted(OWN)


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert all(sql for _fn, sql in OWN.values())
    assert set(OWN) <= set(E.queries()) & set(E.oracle_sql())


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["o_orderstatus", "ship_month", "revenue", "n_lines"]
    assert df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF)
    s_cols, s_rows = rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    cur = duck.execute(E.oracle_sql()[name])
    o_cols, o_rows = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert s_cols == o_cols
    assert len(s_rows) == len(o_rows)
    assert s_rows == o_rows
