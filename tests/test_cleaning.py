"""Cleaning steps on small frames (the original's unit cases)."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import cleaning as C


def frame(spark, rows, cols):
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    return df.withColumn(C.ORDINAL, F.monotonically_increasing_id())


def test_strip_whitespace_and_tokens(spark):
    df = frame(spark, [("  hello  ",), (" world",), ("test\t",), ("　x　",),
                       ("None",), ("nan",), ("",)], ["col1"])
    r = C.CleaningReport()
    out = C.strip_whitespace(r.start(df), r)
    # one plain action (a sort would run the plan twice and double the counts)
    vals = [x["col1"] for x in sorted(out.collect(), key=lambda r: r[C.ORDINAL])]
    assert vals == ["hello", "world", "test", "x", None, None, None]
    rows = r.rows()
    assert rows[0]["rows_modified"] == 7
    assert r.column_warnings["col1"] == ["7 values trimmed"]


def test_blank_rows_and_empty_columns(spark):
    df = frame(spark, [("keep", "1.0", None), (None, None, None), (None, None, None)],
               ["a", "b", "c"])
    out, rep = C.clean(df)
    assert out.count() == 1
    assert out.columns[:2] == ["a", "b"] and "c" not in out.columns
    step = [x for x in rep.rows() if x["step"] == "handle_missing_values"][0]
    assert step["rows_dropped"] == 2
    assert rep.totals()["rejected"] == 2


def test_exact_duplicates(spark):
    df = frame(spark, [("1", "a"), ("2", "b"), ("1", "a"), ("2", "b")], ["x", "y"])
    out, rep = C.clean(df)
    assert out.count() == 2
    d = [x for x in rep.rows() if x["step"] == "deduplicate_rows"][0]
    assert d["rows_dropped"] == 2 and d["warnings"] == ["2 duplicate rows removed"]
    assert rep.totals() == {"rejected": 0, "skipped": 2}


def test_dates_kept(spark):
    df = frame(spark, [("2026-07-28 15:43:08",), ("2026-01-01",)], ["d"])
    out, _ = C.clean(df)
    assert out.count() == 2


def test_date_normalisation_threshold(spark):
    rows = [(f"2024-01-{i:02d}",) for i in range(1, 12)] + [("text",)] * 30
    df = frame(spark, rows, ["d"])
    r = C.CleaningReport()
    kept = C.normalize_dates(df, r)                      # 11 of 41: stays text
    assert dict(kept.dtypes)["d"] == "string"
    conv = C.normalize_dates(df, r, compat=True)         # > 10 cells: converted
    assert dict(conv.dtypes)["d"] == "timestamp_ntz"
    assert conv.filter(F.col("d").isNull()).count() == 30


def test_date_formats_single_digit_fields(spark):
    df = frame(spark, [("2024-1-5",), ("2024-01-05",), ("2024-1-5 3:4:5",)], ["d"])
    out = C.normalize_dates(df, C.CleaningReport())
    got = [r["d"] for r in out.orderBy(C.ORDINAL).collect()]
    assert got[:2] == [dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 5)]
    assert got[2] is None          # the chosen format has no time of day


def test_dedup_by_key_last_wins_and_null_keys(spark):
    df = frame(spark, [("1", "old"), ("1", "new"), (None, "a"), (None, "b")], ["k", "v"])
    out = C.dedup_by_key(df, ["k"]).orderBy("k")
    got = [(r["k"], r["v"]) for r in out.collect()]
    assert got == [(None, "b"), ("1", "new")]


def test_malformed_rows(spark):
    df = frame(spark, [("RB1", "a", "b", "c", "d"), ("WX2", "a", "b", "c", "d"),
                       ("RF3", "a", None, None, None), ("RE4", "a", "b", "c", None),
                       ("nan", "a", "b", "c", "d")], ["c0", "c1", "c2", "c3", "c4"])
    out = C.drop_malformed(df, C.CleaningReport(), r"^(RB|RE|RF)\d+$")
    assert sorted(r["c0"] for r in out.collect()) == ["RB1", "RE4"]


def test_merge_overflow(spark):
    df = frame(spark, [("a", "note", "more"), ("b", None, "x"), ("c", "n", " ")],
               ["k", "remark", "_extra_2"])
    out = C.merge_overflow(df, C.CleaningReport(), expected=2,
                           columns=["k", "remark", "_extra_2"])
    assert out.columns[:2] == ["k", "remark"]
    got = {r["k"]: r["remark"] for r in out.collect()}
    assert got == {"a": "note,more", "b": ",x", "c": "n"}


def test_rule_registry(spark):
    @C.register("t_registry_demo")
    def upper(df, report):
        return df.withColumn("a", F.upper("a"))
    df = frame(spark, [("x",)], ["a"])
    out = C.apply_rules(df, "t_registry_demo", C.CleaningReport())
    assert out.first()["a"] == "X"


def test_date_parsing_ignores_session_time_zone(spark):
    from tessera.functions import dates
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = spark.createDataFrame([("2024-03-10 02:30:00",), ("2024-02-30",), ("2024/1/5",)],
                                   "s string")
        got = [r[0] for r in df.select(dates.parse_multi(F.col("s"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [dt.datetime(2024, 3, 10, 2, 30), None, dt.datetime(2024, 1, 5)]


def test_exports_of_a_table_in_one_file_are_written_by_all_tasks(spark, tmp_path):
    from tessera.queries.cleaning import c_rules
    rows = [(i, "OFP"[i % 3], ("1-URGENT", "2-HIGH", "4-NOT SPECIFIED", "5-LOW")[i % 4]) for i in range(60)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_orderpriority string") \
        .coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    out = c_rules(spark, str(tmp_path))
    files = [f for f in out.inputFiles() if "refund_orders-" in f and "service" not in f]
    assert len(files) == spark.sparkContext.defaultParallelism
    more = {k: p + (",left,over" if s == "F" else "") for k, s, p in rows}
    want = [("refund_orders", f"RB{k}", more[k]) for k, _, p in rows if p[0] in "12"]
    want += [("service_refund_work_orders", f"GD{k}", more[k]) for k, _, p in rows if p[0] in "12"]
    want += [("wallet_withdrawals", f"{'WX' if p[0] == '5' else 'W'}{k}", more[k] if p[0] != "4" else None) for k, _, p in rows]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
