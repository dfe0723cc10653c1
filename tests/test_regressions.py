"""Cases that once gave wrong results."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera_testing import write_csv
from tessera.functions.ranking import POS, SIZE, positions
from tessera.operators import cleaning as C
from tessera.operators import evolution as M
from tessera.operators import upsert as U
from tessera.model import ColumnSpec, TableSpec
from tessera.plans.saved import ViewStore
from tessera.sources.delimited import read_delimited


@pytest.mark.parametrize("values", [400_000, 5])
def test_positions_with_payload_columns(spark, values):
    df = spark.range(400_000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(values)).alias("v"),
                                     F.col("id").alias("p1"), F.lit("x").alias("p2"))
    got = positions(df, ["g"], [F.col("v"), F.col("p1")], num_partitions=16).filter("p2 = 'x'")
    w = Window.partitionBy("g").orderBy("v", "p1")
    want = df.select("p1", (F.row_number().over(w) - 1).alias("want"))
    assert got.join(want, "p1").filter(F.col(POS) != F.col("want")).count() == 0
    assert got.agg(F.min(SIZE)).first()[0] >= 133_333


def test_tied_values_are_spread(spark):
    df = spark.range(200_000).select(F.lit("a").alias("g"), F.lit(0.0).alias("v"), "id")
    spread = df.repartitionByRange(16, "g", "v", F.xxhash64(*df.columns)).groupBy(F.spark_partition_id()).count()
    assert spread.agg(F.max("count")).first()[0] < 2 * 200_000 / 16


def test_scan_orders_files_as_named(spark, tmp_path):
    a = write_csv(f"{tmp_path}/z.csv", "id,name\n1,a\n2,b\n")
    b = write_csv(f"{tmp_path}/a b.csv", "name,id\nc,1\n" + "x,9\n" * 300)
    rows = read_delimited(spark, [a, b]).named().orderBy("_ordinal").collect()
    assert [(r.id, r.name) for r in rows[:3]] == [("1", "a"), ("2", "b"), ("1", "c")]
    assert len({r._ordinal for r in rows}) == 303
    with pytest.raises(ValueError, match="does not name the columns"):
        read_delimited(spark, [a, write_csv(f"{tmp_path}/c.csv", "id,other\n1,2\n")])


def test_wide_row_keeps_every_cell(spark, tmp_path):
    p = write_csv(f"{tmp_path}/w.csv", "a,b\n1,\"2,\"\"x\"\"\",,,,,,,,,,,,,,,,,,,,LOST\n3,4\n")
    raw = read_delimited(spark, p)
    first, second = raw.expanded().orderBy("_ordinal").collect()
    assert raw.width == 22 and first["_c21"] == "LOST" and first["_c1"] == '2,"x"'
    assert (first["_cells"], second["_cells"]) == (22, 2)


def test_unique_check_keeps_one_row_each(spark):
    src = spark.createDataFrame([(1, "v", 0, None), (2, "w", 1, None)], "k long, c string, _ordinal long, _reject string")
    tgt = spark.createDataFrame([(7, "v"), (8, "v"), (9, "v"), (2, "w")], "k long, c string")
    out = {r.k: r._reject for r in U.reject_unique(src, tgt, "c", ["k"]).collect()}
    assert len(out) == 2 and out[1] and out[2] is None


def test_type_change_counts_losses(spark):
    df = spark.createDataFrame([(1.5,), (2.0,), (None,), (-0.5,)], "x double")
    spec = TableSpec("t", [ColumnSpec("x", "Numeric")])
    new, _, lossy, losses = M.change_type(df, spec, "x", "Integer")
    assert lossy and losses.first()[0] == 2
    assert sorted(r.x for r in new.collect() if r.x is not None) == [-1, 2, 2]


def test_views_survive_reopening(spark, tmp_path):
    cfg = {"from_tables": ["orders"]}
    ViewStore(spark, f"{tmp_path}/v").save("one", cfg)
    again = ViewStore(spark, f"{tmp_path}/v")
    again.save("two", cfg)
    again.save("one", {"from_tables": ["customer"]}, replace=True)
    third = ViewStore(spark, f"{tmp_path}/v")
    assert sorted(r.name for r in third.list().collect()) == ["one", "two"]
    assert third.load("one").from_tables == ["customer"]


def test_malformed_rule_counts_cells_not_values(spark, tmp_path):
    head = ",".join(f"c{i}" for i in range(18))
    p = write_csv(f"{tmp_path}/m.csv", head + "\n" + f"RB1,{',' * 16}\n" * 5 + "RB2,x\n")
    raw = read_delimited(spark, p)
    kept = C.drop_malformed(raw.df, C.CleaningReport(), r"^RB\d+$", columns=raw.data_columns)
    assert kept.count() == 5
