"""Records of large delimited files, read in many tasks.

A quoted cell may hold line ends, so a task that starts somewhere in a file cannot
tell from its own bytes where records start. It can tell, though, for each line,
whether the next one starts inside quotes *if* this one does, and if it does not.
Such rules compose: those of a byte range make a rule for the range, and the rules
of the ranges before it tell in which state a range starts. So:

1. Spark's text reader deals the file out in byte ranges and finds the lines; a line
   without quotes leaves the state as it is.
2. Only lines that change the state are gathered, per range, and composed in order;
   a frame of one row per range then gives the state each range starts in.
3. Each range numbers its own lines with their states. A line that starts outside of
   quotes starts a record. Lines of one record are put together again, across ranges
   too; a record of one line is not moved.

Only a quote at the start of a cell opens it, and inside of one a doubled quote is a
quote, as in the parser. Lines end in ``\\n`` or ``\\r\\n``; empty lines outside of
quotes are no records. The state is exact for every charset in which no character
but the line end holds its byte, which all of ``delimited.ENCODINGS`` are.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Rules for a line: bit 0 is the state after it if it starts outside of quotes, bit 1 if inside.
ENDS_OUTSIDE, SWAPS, KEEPS, ENDS_INSIDE = 0, 1, 2, 3
OPEN, CLOSED, TEXT, CELL = 1, 2, 0, 3       # inside quotes, right behind them, behind a quote in a bare cell, at its start
MASK = "\uf8ff"     # stands, with a digit, for a separator inside quotes or for itself


@contextmanager
def any_charset(spark: SparkSession) -> Iterator[None]:
    """While expressions are built: all of Java's charsets, unreadable bytes replaced."""
    names = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    before = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "true")
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def _at_quote(state: Column, piece: Column) -> Column:
    """The state behind a quote, from the one before the text in front of it."""
    cell_starts = piece.endswith(",") | ((piece == "") & (state == CELL))
    return (F.when(state == OPEN, CLOSED).when((state == CLOSED) & (piece == ""), OPEN)
            .when(cell_starts, OPEN).otherwise(TEXT))


def inside_after(line: Column, start: int) -> Column:
    """Is the end of ``line`` inside quotes, when it starts in state ``start``?"""
    pieces = F.split(line, '"')
    return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.lit(start), _at_quote) == OPEN


def cells_of(record: Column) -> Column:
    """All cells of a record as an array: null where nothing stands, doubled quotes as
    one. Text between quotes is every second piece as long as no quote is part of a
    bare cell; only records with such a quote need the state of every piece."""
    pieces = F.split(record, '"')
    before = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    bare_quotes = F.aggregate(before, F.lit(CELL), lambda s, p: F.when(s == TEXT, TEXT).otherwise(_at_quote(s, p))) == TEXT
    states = F.aggregate(before, F.lit(str(CELL)), lambda acc, p: F.concat(
        acc, _at_quote(F.right(acc, F.lit(1)).cast("int"), p).cast("string")))
    text = lambda p: F.replace(p, F.lit(MASK), F.lit(MASK + "0"))       # noqa: E731
    masked = lambda p: F.replace(text(p), F.lit(","), F.lit(MASK + "1"))        # noqa: E731
    alternate = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, masked(p)).otherwise(text(p)))
    by_state = F.transform(F.arrays_zip(pieces.alias("p"), F.split(states, "").alias("s")),
                           lambda z: F.when(z["s"] == str(OPEN), masked(z["p"])).otherwise(text(z["p"])))
    marked = F.array_join(F.when(bare_quotes, by_state).otherwise(alternate), '"')

    def value(c: Column) -> Column:
        inner = F.substring(c, F.lit(2), F.length(c) - 2)
        quoted = (F.length(c) >= 2) & c.startswith('"') & c.endswith('"') & ~F.contains(F.replace(inner, F.lit('""'), F.lit("")), F.lit('"'))
        plain = F.when(quoted, F.replace(inner, F.lit('""'), F.lit('"'))).when(c != "", c)
        return F.replace(F.replace(plain, F.lit(MASK + "1"), F.lit(",")), F.lit(MASK + "0"), F.lit(MASK))

    bare = F.transform(F.split(record, ","), lambda c: F.when(c != "", c))
    return F.when(F.contains(record, F.lit('"')), F.transform(F.split(marked, ","), value)).otherwise(bare)


def rule_of(line: Column) -> Column:
    rule = inside_after(line, CELL).cast("int") + 2 * inside_after(line, OPEN).cast("int")
    return F.when(F.contains(line, F.lit('"')), rule).otherwise(KEEPS)


def apply_rule(state: Column, rule: Column) -> Column:
    return F.when(rule == KEEPS, state).when(rule == SWAPS, 1 - state).otherwise((rule == ENDS_INSIDE).cast("int"))


def state_before(rule: Column, span: Window, start: Column | int) -> tuple[Column, Column]:
    """What ``rule``s of the rows before make of ``start``: the last row that ends in a
    fixed state, and the swaps behind it. First the frame needs the first column, under
    the name ``__fixed``; the second is the state."""
    upto = span.rowsBetween(Window.unboundedPreceding, 0)
    earlier = span.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.sum((rule == SWAPS).cast("int"))
    fixed = F.when(rule.isin(ENDS_OUTSIDE, ENDS_INSIDE), F.struct((rule == ENDS_INSIDE).cast("int").alias("state"),
                                                                   swaps.over(upto).alias("swaps")))
    last = F.last("__fixed", ignorenulls=True).over(earlier)
    behind = F.coalesce(swaps.over(earlier), F.lit(0)) - F.coalesce(last["swaps"], F.lit(0))
    since = start if isinstance(start, Column) else F.lit(start)
    return fixed, (F.coalesce(last["state"], since) + behind) % 2


def records(spark: SparkSession, paths: list[str], charset: str) -> DataFrame:
    """``path, row`` (from 0, in the order of the file) and ``record`` of each record."""
    raw = spark.read.option("lineSep", "\n").text(paths)
    value = F.col("value")
    with any_charset(spark):
        if charset != "UTF-8":
            value = F.decode(value.cast("binary"), charset)
        lines = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                           F.monotonically_increasing_id().alias("id"), value.alias("line"))
    lines = lines.withColumn("rule", rule_of(F.col("line")))

    # One row a range: the rule of all its lines, then the state it starts in.
    changes = F.transform(F.array_sort(F.collect_list(F.when(F.col("rule") != KEEPS, F.struct("id", "rule")))), lambda c: c["rule"])
    after = lambda first: F.aggregate(F.col("changes"), F.lit(first), lambda s, r: apply_rule(s, r))        # noqa: E731
    blocks = (lines.groupBy("path", "block").agg(changes.alias("changes"))
              .select("path", "block", (after(0) + 2 * after(1)).alias("rule")))
    in_file = Window.partitionBy("path").orderBy("block")
    fixed, state = state_before(F.col("rule"), in_file, 0)
    blocks = blocks.withColumn("__fixed", fixed).select("path", "block", state.alias("start"))

    # Every line's own state, and the line that starts its record.
    in_block = Window.partitionBy("path", "block").orderBy("id")
    fixed, state = state_before(F.col("rule"), in_block, F.col("start"))
    lines = lines.join(blocks, ["path", "block"]).withColumn("__fixed", fixed).withColumn("state", state)
    starts = (F.col("state") == 0) & ~F.col("line").isin("", "\r")
    upto = in_block.rowsBetween(Window.unboundedPreceding, 0)
    lines = (lines.withColumn("head", F.last(F.when(starts, F.col("id")), ignorenulls=True).over(upto))
             .withColumn("continues", (F.coalesce(F.lead("state").over(in_block), apply_rule(F.col("state"), F.col("rule"))) == 1))
             .filter(starts | (F.col("state") == 1))
             .select("path", "block", "id", "line", "head", "continues", (F.col("state") == 0).alias("first")))
    lines = cut_lineage(lines)      # read for the pieces of records and for the counts

    # Records of several lines; one that a range before began is known by that range's last start.
    pieces = lines.filter(~F.col("first") | F.col("continues"))
    last = lines.groupBy("path", "block").agg(F.max("head").alias("head"), F.count_if("first").alias("n"))
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    of_block = last.select("path", "block", F.last(F.when(F.col("head").isNotNull(), F.struct("block", "head")), ignorenulls=True)
                           .over(before).alias("open"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "id", "line"))), lambda c: c["line"]), "\n")
    joined = (pieces.join(of_block, ["path", "block"])
              .withColumn("home", F.when(F.col("head").isNotNull(), F.struct("block", "head")).otherwise(F.col("open")))
              .groupBy("path", "home").agg(whole.alias("record"))
              .select("path", F.col("home.block").alias("block"), F.col("home.head").alias("id"), "record"))
    single = lines.filter(F.col("first") & ~F.col("continues")).select("path", "block", "id", F.col("line").alias("record"))
    place = F.row_number().over(in_block) - 1
    return (single.unionByName(joined).withColumn("place", place).join(of_block.drop("open"), ["path", "block"])
            .select("path", (F.col("rows_before") + F.col("place")).alias("row"), F.regexp_replace("record", "\r$", "").alias("record")))
