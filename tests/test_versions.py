"""Stored tables: files touched by an import, columns without rewrites, durable names."""

import pytest
from pyspark.sql import functions as F

from tessera_testing import write_csv
from tessera.catalog import Catalog, CatalogError
from tessera.model import ColumnSpec, TableSpec
from tessera.plans.imports import import_files, import_frame
from tessera.plans.saved import import_history
from tessera.sources.schema import create_table
from tessera.streaming.drop_folder import start_folder_import
from tessera.versions import ConcurrentWrite, JobLog, VersionedTable, VersionError, create_text

SPEC = TableSpec("stock", [ColumnSpec("sku", "Integer", primary_key=True, nullable=False),
                           ColumnSpec("place", "String", 20), ColumnSpec("amount", "Integer", default=0)])


@pytest.fixture()
def cat(spark, tmp_path):
    return Catalog.open(spark, str(tmp_path / "with space"))


def filled(spark, cat, n=400, parts=8):
    create_table(spark, SPEC, catalog=cat)
    table = cat.versioned("stock")
    for k in range(parts):      # files of known key ranges
        rows = spark.range(k * n // parts, (k + 1) * n // parts).select(
            F.col("id").cast("int").alias("sku"), F.lit("hall").alias("place"), F.lit(1).alias("amount"),
            F.lit(None).cast("timestamp_ntz").alias("imported_at")).coalesce(1)
        table.commit(rows)
    return table


def listed(table):
    return {r["file"]: (r["rows"], r["low"], r["high"]) for r in table.files().collect()}


def test_merge_rewrites_only_files_with_updated_rows(spark, cat, tmp_path):
    table = filled(spark, cat)
    before = listed(table)
    f = write_csv(f"{tmp_path}/a.csv", "sku,place,amount\n3,hall,1\n120,yard,5\n130,hall,1\n500,gate,2\n")
    out = import_files(cat, "stock", f)
    assert (out.rows_inserted, out.rows_updated, out.rows_skipped) == (1, 1, 2)
    after = listed(table.refresh())
    gone = [before[p] for p in before if p not in after]
    assert gone == [(50, 100, 149)]                     # the file of key 120, and no other
    assert sum(n for n, _, _ in after.values()) == 401
    rows = {r.sku: (r.place, r.amount) for r in cat.table("stock").collect()}
    assert rows[120] == ("yard", 5) and rows[500] == ("gate", 2) and rows[3] == ("hall", 1) and len(rows) == 401


def test_key_ranges_leave_files_out(spark, cat):
    table = filled(spark, cat)
    assert table.files(60, 70).count() == 1 and table.files(49, 50).count() == 2 and table.files(900, 950).count() == 0


def test_unchanged_file_makes_no_version(spark, cat, tmp_path):
    table = filled(spark, cat, 20, 2)
    f = write_csv(f"{tmp_path}/a.csv", "sku,place,amount\n3,hall,1\n")
    version = table.version
    assert import_files(cat, "stock", f).rows_skipped == 1 and table.refresh().version == version


def test_keyless_tables_only_add_files(spark, cat, tmp_path):
    for name, dedup, want in (("log", False, 4), ("once", True, 2)):
        create_table(spark, TableSpec(name, [ColumnSpec("a", "String", 9), ColumnSpec("b", "Integer")], dedup=dedup), catalog=cat)
        f = write_csv(f"{tmp_path}/{name}.csv", "a,b\nx,1\ny,2\n")
        import_files(cat, name, f)
        first = set(listed(cat.versioned(name)))
        import_files(cat, name, f)
        assert first <= set(listed(cat.versioned(name).refresh())) and cat.table(name).count() == want


def test_columns_change_without_data(spark, cat):
    table = filled(spark, cat, 20, 2)
    files = listed(table)
    table.add_column(ColumnSpec("unit", "String", 5, default="kg"))
    table.add_column(ColumnSpec("note", "String", 5))
    table.drop_column("place")
    table.rename_column("amount", "count")
    table.add_column(ColumnSpec("place", "Integer", default=7))     # the old name, another column
    assert listed(table) == files
    row = Catalog.open(spark, cat.root).table("stock").filter("sku = 3").drop("imported_at").first().asDict()
    assert row == {"sku": 3, "count": 1, "unit": "kg", "note": None, "place": 7}
    table.commit(spark.createDataFrame([(99, 2, None, "n", None, None)],
                                       "sku int, count int, unit string, note string, place int, imported_at timestamp_ntz"))
    assert cat.table("stock").filter("unit IS NULL").count() == 1        # a stored null is no default
    for bad in (lambda: table.drop_column("sku"), lambda: table.rename_column("count", "unit"), lambda: table.drop_column("x"),
                lambda: table.add_column(ColumnSpec("q", nullable=False)), lambda: table.add_column(ColumnSpec("unit"))):
        with pytest.raises(VersionError):
            bad()
    assert [c.name for c in table.at(2).columns] == ["sku", "place", "amount", "imported_at"]


def test_names_survive_the_session(spark, cat):
    filled(spark, cat, 20, 2)
    cat.rename("stock", "goods")
    again = Catalog.open(spark, cat.root)
    assert again.names() == ["goods"] and again.specs["goods"].key() == ["sku"] and again.table("goods").count() == 20
    with pytest.raises(CatalogError):
        again.create(TableSpec("goods", SPEC.columns))
    again.drop("goods")
    assert Catalog.open(spark, cat.root).names() == []


def test_two_writers_of_one_version(spark, cat):
    table = filled(spark, cat, 20, 2)
    late = VersionedTable(spark, table.path)
    table.rename_column("amount", "n")
    with pytest.raises(ConcurrentWrite):
        late.rename_column("amount", "m")
    assert late.refresh().column("n")
    create_text(spark, f"{table.path}/versions/{table.version + 1:08d}.json", '{"half')    # a writer that died
    assert table.refresh().column("n")


def test_job_log_is_read_by_another_session(spark, cat, tmp_path):
    filled(spark, cat, 20, 2)
    log = JobLog(spark, f"{cat.root}/log")
    assert log.jobs().count() == 0
    f = write_csv(f"{tmp_path}/a.csv", "sku,place,amount\n3,yard,1\nx,hall,1\n")
    import_files(cat, "stock", f, log=log, run="r1", source_id="s")
    sources = spark.createDataFrame([("s", "a.csv", "csv")], "id string, name string, source_type string")
    page, total = import_history(JobLog(spark, f"{cat.root}/log").jobs(), sources)
    job = page.first()
    assert (job.id, job.rows_updated, job.rows_rejected, job.source_name, job.version) == ("r1", 1, 1, "a.csv", 3)
    assert total.first().total == 1 and [r.row for r in log.rejects("r1").collect()] == [1]


def test_a_batch_delivered_twice_is_stored_once(spark, cat, tmp_path):
    spec = TableSpec("feed", [ColumnSpec("a", "String", 9)], dedup=False)
    create_table(spark, spec, catalog=cat)
    df = spark.createDataFrame([("x",), ("y",)], "a string")
    assert import_frame(cat, "feed", df, spec, batch=("in", 0)).rows_inserted == 2
    assert import_frame(Catalog.open(spark, cat.root), "feed", df, spec, batch=("in", 0)) is None
    assert import_frame(cat, "feed", df, spec, batch=("in", 1)).rows_inserted == 2
    assert cat.table("feed").count() == 4


def test_stream_restarts_on_the_stored_table(spark, cat, tmp_path):
    spec = TableSpec("feed", [ColumnSpec("a", "String", 9), ColumnSpec("b", "Integer")], dedup=False)
    create_table(spark, spec, catalog=cat)
    folder, ckpt = tmp_path / "in", str(tmp_path / "ckpt")
    folder.mkdir()
    for name, text in (("1.csv", "a,b\nx,1\n"), ("2.csv", "a,b\ny,2\n")):
        write_csv(f"{folder}/{name}", text)
        fresh = Catalog.open(spark, cat.root)       # as a restarted driver sees it
        start_folder_import(fresh, "feed", str(folder), checkpoint=ckpt).awaitTermination()
    assert sorted(r.a for r in Catalog.open(spark, cat.root).table("feed").collect()) == ["x", "y"]
