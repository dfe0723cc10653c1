"""Schema evolution, saved views, dependency scan, drop-folder streaming."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tessera_testing import SF, write_csv
from tessera.catalog import Catalog
from tessera.model import ColumnSpec, TableSpec
from tessera.operators import evolution as M
from tessera.plans.saved import ViewStore, import_history
from tessera.sources.schema import create_table, table_overview
from tessera.streaming.drop_folder import start_folder_import

SPEC = TableSpec("dept", [ColumnSpec("dept_id", "Integer", primary_key=True, nullable=False),
                          ColumnSpec("name", "String", 20), ColumnSpec("code", "String", 5)])


def dept(spark):
    return spark.createDataFrame([(1, "A", "1"), (2, "B", "x"), (3, None, "3")],
                                 "dept_id int, name string, code string")


def test_add_drop_rename(spark):
    df, spec = M.add_column(dept(spark), SPEC, ColumnSpec("region", "String", 10, default="东"))
    assert {r["region"] for r in df.collect()} == {"东"} and "region" in spec.names
    with pytest.raises(M.EvolutionError):
        M.add_column(df, spec, ColumnSpec("pk", "Integer", primary_key=True))
    with pytest.raises(M.EvolutionError):
        M.drop_column(df, spec, "dept_id")
    child = TableSpec("emp", [ColumnSpec("d", "Integer", fk=("dept", "code"))])
    with pytest.raises(M.EvolutionError):
        M.drop_column(df, spec, "code", children=[child])
    df2, spec2 = M.rename_column(df, spec, "name", "title")
    assert "title" in df2.columns and "title" in spec2.names


def test_change_type_and_constraints(spark):
    _df, _s, lossy, losses = M.change_type(dept(spark), SPEC, "code", "Integer")
    assert lossy and losses.first()["lossy_rows"] == 1
    _df, _s, lossy, _ = M.change_type(dept(spark), SPEC, "name", "Text")
    assert not lossy
    assert M.null_violations(dept(spark), "name").first()["violations"] == 1
    with pytest.raises(M.EvolutionError):
        M.assert_not_null(dept(spark), "name")
    M.assert_unique(dept(spark), "code")
    dup = spark.createDataFrame([(1, "a"), (2, "a")], "dept_id int, name string")
    with pytest.raises(M.EvolutionError):
        M.set_key(dup, SPEC, ["name"])
    nopk = TableSpec("dept", [ColumnSpec("dept_id", "Integer"), ColumnSpec("name", "String", 20),
                              ColumnSpec("code", "String", 5)], upsert_key=["dept_id"])
    keyless, spec = M.set_key(dept(spark), nopk, None, dedup=True)
    assert "content_hash" in keyless.columns and spec.key() is None
    kept, _ = M.set_key(dept(spark), SPEC, None, dedup=True)
    assert "content_hash" not in kept.columns


def test_saved_views_and_dependencies(spark, tmp_path):
    cat = Catalog.from_dir(spark, SF)
    store = ViewStore(spark, f"{tmp_path}/views")
    cfg = {"from_tables": ["orders"], "columns": [{"table": "orders", "column": "o_orderkey"}]}
    store.save("keys", cfg, now=dt.datetime(2026, 1, 1))
    store.save("nations", {"from_tables": ["nation"]}, now=dt.datetime(2026, 1, 2))
    with pytest.raises(Exception):
        store.save("keys", cfg)
    assert [r["name"] for r in store.list().collect()] == ["nations", "keys"]
    assert [r["name"] for r in store.list(descending=False).collect()] == ["keys", "nations"]
    assert store.run(cat, "keys").count() == cat.table("orders").count()
    deps = [r["name"] for r in M.dependencies(store.frame(), "orders").collect()]
    assert deps == ["keys"]
    assert M.dependencies(store.frame(), "orders", "o_custkey").count() == 0
    assert M.dependencies(store.frame(), "order").count() == 0      # whole words only
    with pytest.raises(M.EvolutionError):
        M.drop_table(cat, "orders", views=store.frame())
    M.drop_table(cat, "orders", views=store.frame(), confirm=True)
    assert "orders" not in cat


def test_overview_history_create(spark, tmp_path):
    cat = Catalog.from_dir(spark, SF)
    ov = {r["table"]: r for r in table_overview(cat, ["nation", "region"]).collect()}
    assert ov["nation"]["row_count"] == 25 and ov["region"]["column_count"] == 2
    spec = TableSpec("notes", [ColumnSpec("title", "String", 10)])
    df = create_table(spark, spec, f"{tmp_path}/notes", cat)
    assert df.count() == 0 and "content_hash" in df.columns and "imported_at" in df.columns
    jobs = spark.createDataFrame([(1, 10, dt.datetime(2026, 1, 1)), (2, 10, dt.datetime(2026, 1, 2)),
                                  (3, 11, dt.datetime(2026, 1, 3))],
                                 "id long, source_id long, created_at timestamp_ntz")
    sources = spark.createDataFrame([(10, "a", "csv"), (11, "b", "csv")],
                                    "id long, name string, source_type string")
    page, total = import_history(jobs, sources, page=1, size=2)
    assert [r["id"] for r in page.collect()] == [3, 2] and total.first()["total"] == 3


def test_drop_folder_stream(spark, tmp_path):
    cat = Catalog(spark)
    spec = TableSpec("dept", [ColumnSpec("dept_id", "Integer", primary_key=True, nullable=False),
                              ColumnSpec("name", "String", 20)])
    create_table(spark, spec, f"{tmp_path}/dept-v0", cat)
    drop = f"{tmp_path}/drop"
    os.makedirs(drop)
    write_csv(f"{drop}/1.csv", "dept_id,name\n1,A\n2,B\n")
    results = []
    q = start_folder_import(cat, "dept", drop, checkpoint=f"{tmp_path}/ck", results=results)
    q.awaitTermination(120)
    write_csv(f"{drop}/2.csv", "dept_id,name\n2,B2\n3,C\n")
    q = start_folder_import(cat, "dept", drop, checkpoint=f"{tmp_path}/ck", results=results)
    q.awaitTermination(120)
    assert [(r["rows_inserted"], r["rows_updated"]) for r in results] == [(2, 0), (1, 1)]
    assert cat.table("dept").count() == 3
