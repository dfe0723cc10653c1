"""Records of files that many tasks read, against Python's csv reader and the unsplit scan."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources.delimited import read_delimited
from tessera.sources.split_scan import cells_of, records, rule_of

CELLS = ["a", "", 'x"y', 'say "hi"', "line\nbreak", "a,b", "\n", '"', 'q"\n"', " z", "中文", '5" pipe', '\n\n,"', "\r\n,x"]


def written(path, seed, rows=500, width=4, encoding="utf-8", eol="\n"):
    """Records of 1 to ``width`` + 2 cells, some quoted without need, empty lines between."""
    rnd, out = random.Random(seed), ["h0,h1,h2,h3"]
    for _ in range(rows):
        row = []
        for _ in range(rnd.randrange(1, width + 3)):
            c = rnd.choice(CELLS)
            if rnd.random() < .5 or any(x in c for x in "\n,") or c.startswith('"'):
                c = '"' + c.replace('"', '""') + '"'
            row.append(c)
        out.append(",".join(row))
        if rnd.random() < .05:
            out.append("")
    with open(path, "wb") as f:
        f.write((eol.join(out) + rnd.choice(["", eol])).encode(encoding))
    return str(path)


@pytest.fixture()
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "600", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.mark.parametrize("encoding,charset,eol", [("utf-8", "UTF-8", "\n"), ("gbk", "GBK", "\r\n")])
def test_records_equal_the_csv_reader(spark, tmp_path, small_splits, encoding, charset, eol):
    p = written(tmp_path / "r.csv", 1, encoding=encoding, eol=eol)
    assert spark.read.option("lineSep", "\n").text(p).rdd.getNumPartitions() >= 8
    got = sorted(records(spark, [p], charset).collect(), key=lambda r: r.row)
    with open(p, encoding=encoding, newline="") as f:
        want = [r for r in csv.reader(f) if r]
    assert [r.row for r in got] == list(range(len(want)))
    assert [next(csv.reader(io.StringIO(r.record, newline=""))) for r in got] == want


def test_rules_of_lines(spark):
    cases = [('a,b', 2), ('"a', 3), ('a"', 0), ('x,"a', 1), ('"a"', 2), ('a"b', 0), ('""', 2), ('"",', 2), ('5" x', 0), ('","', 3)]
    df = spark.createDataFrame(cases, "line string, want int").withColumn("got", rule_of(F.col("line")))
    for r in df.collect():
        def inside(text):       # is the end of the text inside quotes?
            state = "cell"
            for ch in text:
                if state == "open":
                    state = "closed" if ch == '"' else "open"
                elif ch == '"' and state in ("cell", "closed"):
                    state = "open"
                else:
                    state = "cell" if ch == "," else "text"
            return state == "open"
        assert r.got == int(inside(r.line)) + 2 * int(inside('"' + r.line)), r.line


def test_same_frame_either_way(spark, tmp_path, small_splits):
    paths = [written(tmp_path / f"{k}.csv", k, rows=300) for k in (2, 3)]
    split = read_delimited(spark, paths)
    whole = read_delimited(spark, paths, split_bytes=1 << 30)
    assert split.headers == whole.headers and split.width == whole.width == 6
    cols = [*split.data_columns, "_more", "_source_file", "_ordinal", "_cells"]
    one, two = (sorted(map(tuple, f.df.select(*cols).collect()), key=lambda r: r[-2]) for f in (split, whole))
    assert one == two and len(one) > 500


def test_a_record_over_many_ranges_and_one_without_end(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i}" for i in range(500))
    p = tmp_path / "long.csv"
    p.write_bytes(f'k,v\n1,"{long}"\n2,b\n3,"never closed\nx\ny'.encode())
    got = [r.record for r in sorted(records(spark, [str(p)], "UTF-8").collect(), key=lambda r: r.row)]
    assert got == ["k,v", f'1,"{long}"', "2,b", '3,"never closed\nx\ny']


def test_charset_settings_are_restored(spark, tmp_path, small_splits):
    records(spark, [written(tmp_path / "g.csv", 5, rows=50, encoding="gbk")], "GBK").count()
    assert spark.conf.get("spark.sql.legacy.codingErrorAction", "false") == "false"


def test_cells_equal_the_csv_reader(spark, tmp_path):
    p = written(tmp_path / "c.csv", 7, rows=400)
    with open(p, newline="") as f:
        want = [r for r in csv.reader(f) if r]
    df = records(spark, [p], "UTF-8").select("row", cells_of(F.col("record")).alias("cells"))
    got = [[c or "" for c in r.cells] for r in sorted(df.collect(), key=lambda r: r.row)]
    assert got == want


def test_odd_cells(spark):
    mask = "\uf8ff"
    cases = [('a,5" x,"b,c"', ["a", '5" x', "b,c"]), (f'{mask},"{mask}1,{mask}"', [mask, f"{mask}1,{mask}"]),
             ('"x"y,z', ['"x"y', "z"]), (',"",', [None, "", None]), ('5" a,5" b,"1,""2"""', ['5" a', '5" b', '1,"2"']), ("", [None])]
    df = spark.createDataFrame([(r,) for r, _ in cases], "r string").select("r", cells_of(F.col("r")).alias("c"))
    assert {r.r: r.c for r in df.collect()} == dict(cases)


def test_a_row_of_very_many_cells(spark, tmp_path):
    p = tmp_path / "wide.csv"
    p.write_text("a,b\n1,2\n" + ",".join(str(i) for i in range(100_000)) + "\n" + ",".join(f'"q,{i}"' for i in range(50_000)) + "\n,,x\n,,\n3\n")
    raw = read_delimited(spark, str(p))
    assert raw.data_columns == ["_c0", "_c1"]
    rows = raw.df.orderBy("_ordinal").collect()
    assert [r["_cells"] for r in rows] == [2, 100_000, 50_000, 3, 1] and raw.width == 100_000
    assert rows[0]["_more"] is None and rows[1]["_more"][-1] == "99999" and rows[2]["_more"][-1] == "q,49999"
    assert (rows[3]["_c0"], rows[3]["_more"]) == (None, ["x"]) and rows[4]["_more"] is None


def test_overflow_merges_cells_beyond_the_header(spark, tmp_path):
    from tessera.operators import cleaning as C
    p = tmp_path / "o.csv"
    p.write_text("a,b\n1,x,y,,z,,\n2,,k\n3,v,,\n4,w\n")
    raw = read_delimited(spark, str(p))
    out = C.merge_overflow(raw.df, C.CleaningReport(), 2, raw.data_columns)
    assert "_more" not in out.columns
    assert {r["_c0"]: r["_c1"] for r in out.collect()} == {"1": "x,y,,z", "2": ",k", "3": "v", "4": "w"}


def test_a_record_is_cut_once_whatever_filters_follow(spark, tmp_path):
    p = tmp_path / "once.csv"
    p.write_text('a,b\n1,2\n3\n4,5,6\n\t,　\n,, \n,,z\n"", ,"\t"\n')

    def cuts(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("split(")

    raw = read_delimited(spark, str(p))
    once = cuts(spark.createDataFrame([("a,b",)], "r string").select(cells_of(F.col("r")).alias("c")))
    few = raw.df.filter("_cells <> 2 AND size(_more) > 0")
    assert cuts(few) == once
    assert [(r["_c0"], r["_c1"], r["_more"]) for r in few.orderBy("_ordinal").collect()] == [("4", "5", ["6"]), (None, None, ["z"])]
    assert [r["_cells"] for r in raw.df.orderBy("_ordinal").collect()] == [2, 1, 3, 3]
