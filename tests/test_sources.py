"""File scan, encodings, ragged rows, inference and header mapping."""

import pytest
from pyspark.sql import functions as F

from tessera_testing import write_csv
from tessera.model import ColumnSpec, TableSpec
from tessera.sources.delimited import detect_encodings, read_delimited
from tessera.sources.schema import SchemaMismatch, column_names, infer_schema, map_headers


def test_ragged_rows_and_blank_lines(spark, tmp_path):
    p = write_csv(f"{tmp_path}/r.csv", "river,length\nElbe,1094,Hamburg,\nOder\n , \n\n")
    raw = read_delimited(spark, p)
    rows = {r["_c0"]: (r["_c1"], r["_more"], r["_cells"]) for r in raw.df.collect()}
    assert rows == {"Elbe": ("1094", ["Hamburg", None], 4), "Oder": (None, None, 1)}
    assert raw.named().columns == ["river", "length", "_extra_2", "_extra_3", "_source_file", "_ordinal"]


def test_quoted_newlines_tabs_and_bom(spark, tmp_path):
    p = write_csv(f"{tmp_path}/q.csv", "﻿ 名称 ,备注\n甲,\"第一行\n第二行\"\n乙,\tx\t\n")
    raw = read_delimited(spark, p)
    assert raw.headers == ["名称", "备注"]
    rows = raw.df.orderBy("_ordinal").collect()
    assert rows[0]["_c1"] == "第一行\n第二行" and rows[1]["_c1"] == "x"


def test_encoding_detection(spark, tmp_path):
    p1 = write_csv(f"{tmp_path}/u.csv", "a,b\n中,文\n")
    p2 = f"{tmp_path}/g.csv"
    with open(p2, "wb") as f:
        f.write("a,b\n中文,测试\n".encode("gbk"))
    enc = {k.rsplit("/", 1)[-1]: v for k, v in detect_encodings(spark, [p1, p2]).items()}
    assert enc["u.csv"] == "utf-8-sig" and enc["g.csv"] == "gbk"


def test_infer_types_of_columns(spark, tmp_path):
    p = write_csv(f"{tmp_path}/i.csv", "车牌,里程,首次登记,颜色\nB-XY 12,80.25,2019/03/31,rot\n"
                                     "HH-A 7,-3,2020/11/02,\nM-Q 99,1e3,2021/01/15,blau\n")
    raw = read_delimited(spark, p)
    specs = infer_schema(raw.df, raw.headers)
    assert [(s.name, s.type) for s in specs] == [("col_1", "String"), ("col_2", "Numeric"), ("col_3", "Date"), ("col_4", "String")]


def test_infer_labels_integers_and_empty_columns(spark, tmp_path):
    p = write_csv(f"{tmp_path}/j.csv", "  城市 ,nothing,Rank\nKiel,,7\n\nUlm, ,-12\n")
    raw = read_delimited(spark, p)
    specs = infer_schema(raw.df, raw.headers)
    assert raw.df.count() == 2 and specs[0].label == "城市"
    assert (specs[1].type, specs[1].length, specs[2].type, specs[2].name) == ("String", 255, "Integer", "rank")


def test_infer_bigint_datetime_text(spark):
    rows = [("3000000000", "2024-01-01 10:00:00", "x" * 201)]
    df = spark.createDataFrame(rows, "_c0 string, _c1 string, _c2 string")
    s = infer_schema(df, ["big", "when", "long"])
    assert [x.type for x in s] == ["BigInteger", "DateTime", "Text"]


def test_column_names():
    headers = ["Order Date", "order", "金额", "id", " Unit__Price ", "order", "order_2", "2nd", "_x", None, "order date", "é"]
    assert column_names(headers) == ["order_date", "order_2", "col_3", "id_2", "unit_price", "order_3", "order_2_2", "col_8",
                                     "col_9", "col_10", "order_date_2", "col_12"]
    assert column_names([]) == []


def test_header_gate(spark, tmp_path):
    spec = TableSpec("t", [ColumnSpec("no", "String", nullable=False, label="单号"),
                           ColumnSpec("amt", "Numeric", label="金额"),
                           ColumnSpec("r1", "Text", label="备注"),
                           ColumnSpec("r2", "Text", label="备注")])
    p = write_csv(f"{tmp_path}/h.csv", "单号,金额,备注,备注\nA,1,x,y\n")
    df = map_headers(read_delimited(spark, p), spec)
    row = df.first()
    assert (row["no"], row["r1"], row["r2"]) == ("A", "x", "y")
    bad = write_csv(f"{tmp_path}/b.csv", "金额,其它\n1,2\n")
    with pytest.raises(SchemaMismatch) as e:
        map_headers(read_delimited(spark, bad), spec)
    assert e.value.missing == ["单号"] and e.value.unexpected == ["其它"]


def test_header_of_more_than_one_head(spark, tmp_path):
    names = [f"a rather long name of column {i}" for i in range(6000)]
    p = write_csv(f"{tmp_path}/wide.csv", ",".join(names) + "\n" + ",".join(["v"] * 5999 + ["last"]) + "\n")
    raw = read_delimited(spark, p)
    assert raw.headers == names
    assert raw.df.select("_c5999", "_cells").first() == ("last", 6000)


def test_header_that_never_ends_is_refused(spark, tmp_path):
    p = write_csv(f"{tmp_path}/open.csv", 'a,"b\n' + "x,y\n" * 100_000)
    with pytest.raises(ValueError, match="open.csv"):
        read_delimited(spark, p)


def test_long_first_cell_behind_a_long_header(spark, tmp_path):
    names = [f"name {i:070d}" for i in range(1000)]
    p = write_csv(f"{tmp_path}/cell.csv", ",".join(names) + "\n" + "y" * 300_000 + "\n")
    assert read_delimited(spark, p).df.select(F.length("_c0")).first()[0] == 300_000


def test_many_small_files_of_several_encodings(spark, tmp_path):
    for i in range(300):
        write_csv(f"{tmp_path}/{i:03d}.csv", f"城市,n\n柏林,{i}\n", "gbk" if i % 2 else "utf-8")
    raw = read_delimited(spark, str(tmp_path))
    rows = raw.df.orderBy("_ordinal").collect()
    assert [int(r["_c1"]) for r in rows] == list(range(300)) and {r["_c0"] for r in rows} == {"柏林"}


def test_sessions_charset_setting_is_left_alone(spark, tmp_path):
    key = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        read_delimited(spark, write_csv(f"{tmp_path}/u.csv", "a,b\n1,2\n")).df.collect()
        assert spark.conf.get(key, "false") == "false"
    finally:
        if before is not None:
            spark.conf.set(key, before)
