"""Delimited file scan (S1), encoding detection (S2), ragged rows (S3) and
blank-line drop (S5).

The driver looks at the head of each file only, at many files at once: its first
``HEAD_BYTES`` tell its encoding, and it is read on to where the header record ends
(one of more than ``MAX_HEADER`` bytes is refused). Everything else is one parse by Spark's CSV
reader in multi-line mode (quoted cells may hold newlines), every column as
text, headers skipped by the reader file by file. Files of more than one input
split are cut into records by ``split_scan`` first, in as many tasks as they have
splits, and the same parser reads the records. Files whose headers name the
same columns in another order are brought to the first file's order; files with
other columns are refused.

A row whose number of cells differs from the header's comes with its raw record.
The record is cut into cells there and then: they are counted, and those beyond the
header's columns ride along as one array, so no cell is lost, however wide a row,
and the plan is as wide as the header. ``RawFrame.expanded`` makes columns of them.

Each row carries an ingest ordinal: the file's position in the caller's list in
the high bits, the row's position in its file in the low ones. It is the same in
every attempt of a task and whichever way the file is read, and it is what "last
row wins" rules order by.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.cleaning import MORE, ORDINAL, RAW_CELLS, WS_CHARS, py_strip
from .split_scan import cells_of, records

SOURCE_FILE = "_source_file"
HEAD_BYTES = 1 << 16
MAX_HEADER = 1 << 24
HEADS_AT_ONCE = 32                  # files that the driver looks at together
FILE_BITS = 40                      # ordinal = file << FILE_BITS | row
MAX_COLUMNS = 1 << 20

# Encodings tried in order on a file's first characters.
ENCODINGS = ("utf-8-sig", "utf-8", "gbk", "gb2312", "gb18030", "latin-1")
SAMPLE_CHARS = 4096
# Python codec name -> Java charset name for Spark's reader
JAVA_CHARSETS = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "gbk": "GBK", "gb2312": "GB2312",
                 "gb18030": "GB18030", "latin-1": "ISO-8859-1"}
BUILT_IN = {"UTF-8", "ISO-8859-1", "US-ASCII", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32"}     # what Spark's reader takes
_RAW = "__raw"


@dataclass
class RawFrame:
    """An all-text frame: ``headers`` are the cleaned file headers, the data
    columns are ``_c0.._cN`` (positional; a header may repeat), plus ``_more`` (the
    cells beyond them, if any), ``_source_file``, ``_ordinal`` and ``_cells``, the
    cells its record had."""
    df: DataFrame
    headers: list[str]

    @property
    def data_columns(self) -> list[str]:
        return [c for c in self.df.columns if re.fullmatch(r"_c\d+", c)]

    @cached_property
    def width(self) -> int:
        """Cells of the widest row; a job of its own."""
        return max(len(self.data_columns), self.df.agg(F.max(RAW_CELLS)).first()[0] or 0)

    def expanded(self) -> DataFrame:
        """The frame with a column for each cell of the widest row."""
        n = len(self.data_columns)
        more = [F.get(MORE, F.lit(i - n)).alias(f"_c{i}") for i in range(n, self.width)]
        return self.df.select(*self.data_columns, *more, SOURCE_FILE, ORDINAL, RAW_CELLS)

    def named(self) -> DataFrame:
        """Columns renamed to headers (``_extra_i`` beyond the header)."""
        names = list(self.headers) + [f"_extra_{i}" for i in range(len(self.headers), self.width)]
        return self.expanded().select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)], SOURCE_FILE, ORDINAL)


@dataclass
class _File:
    path: str
    encoding: str
    header: tuple[str, ...]
    large: bool = False


def _first_that_decodes(head: bytes) -> str:
    """The first encoding in which the first SAMPLE_CHARS characters are valid;
    a character cut off at the end of ``head`` is not an error."""
    for enc in ENCODINGS:
        try:
            codecs.getincrementaldecoder(enc)().decode(head[:SAMPLE_CHARS * 4], final=False)
            return enc
        except UnicodeError:
            continue
    return ENCODINGS[0]


def _listed(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files of the paths, folders in order of their file names."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in map(path_of, paths):
        fs = p.getFileSystem(conf)
        if fs.getFileStatus(p).isDirectory():
            found = [s.getPath() for s in fs.listStatus(p) if s.isFile() and s.getPath().getName()[0] not in "._"]
            out += sorted((f.toString() for f in found), key=lambda x: x.rsplit("/", 1)[-1])
        else:
            out.append(fs.makeQualified(p).toString())
    return out


def _is_large(spark: SparkSession, path: str, split_bytes: int) -> bool:
    """Is the file more than one split, and of a kind that can be split?"""
    jvm = spark._jvm
    p, conf = jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()
    packed = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
    return packed is None and p.getFileSystem(conf).getFileStatus(p).getLen() > split_bytes


def _head(spark: SparkSession, path: str, enough=lambda head: True) -> bytes:
    """The start of a file: ``HEAD_BYTES``, doubled until there is ``enough`` or no more."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    head, want = b"", HEAD_BYTES
    try:
        while True:
            part = jvm.org.apache.commons.io.input.BoundedInputStream(stream, want - len(head))
            head += bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(part))
            if len(head) < want or enough(head):
                return head
            if want >= MAX_HEADER:
                raise ValueError(f"{path}: the header record does not end within {MAX_HEADER} bytes")
            want *= 2
    finally:
        stream.close()


def _of_each(look, paths: list[str]) -> list:
    """``look`` at all files, ``HEADS_AT_ONCE`` at a time; in the order of the paths."""
    if not paths:
        return []
    with ThreadPool(min(HEADS_AT_ONCE, len(paths))) as pool:
        return pool.map(look, paths, chunksize=1)


def detect_encodings(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Per file the first encoding of ``ENCODINGS`` that decodes its first
    characters. Reads file heads only."""
    found = _listed(spark, paths)
    return dict(zip(found, _of_each(lambda p: _first_that_decodes(_head(spark, p)), found)))


def _first_record(head: bytes, encoding: str) -> tuple[list[str], bool]:
    """The first record that has cells, and whether anything in ``head`` follows it."""
    text = codecs.getincrementaldecoder(encoding)(errors="replace").decode(head, final=False)
    records = csv.reader(io.StringIO(text, newline=""))
    first = next(filter(None, records), [])
    try:
        return first, next(records, None) is not None
    except csv.Error:       # a cell of the next one is very long
        return first, True


def _looked_at(spark: SparkSession, path: str, encoding: str | None, split_bytes: int) -> _File:
    def enough(head: bytes) -> bool:
        return _first_record(head, encoding or _first_that_decodes(head))[1]

    try:
        head = _head(spark, path, enough)
        enc = encoding or _first_that_decodes(head)
        first, _ = _first_record(head, enc)
    except csv.Error as e:
        raise ValueError(f"{path}: no header record ({e})") from e
    names = tuple(c.replace("\t", "").strip().lstrip("﻿").strip() for c in first)
    return _File(path, enc, names, _is_large(spark, path, split_bytes))


def read_delimited(spark: SparkSession, paths, encoding: str | None = None, header: bool = True,
                   split_bytes: int | None = None) -> RawFrame:
    """S1 + S3 + S5: read delimited files as text. Files of more than ``split_bytes``
    (the session's split size) are read in parallel.

    * tabs are removed from every cell, header cells are trimmed and lose
      byte-order marks;
    * rows wider than the header keep all their cells (``_more``), short
      rows are NULL-padded;
    * rows whose cells are all blank are dropped (not counted anywhere).
    """
    if split_bytes is None:
        split_bytes = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    files = _of_each(lambda p: _looked_at(spark, p, encoding, split_bytes),
                     _listed(spark, [paths] if isinstance(paths, str) else list(paths)))
    headers = next((f.header for f in files if f.header), ())
    for f in files:
        if header and f.header and Counter(f.header) != Counter(headers):
            raise ValueError(f"{f.path}: header {list(f.header)} does not name the columns of the first file, {list(headers)}")
    if any(JAVA_CHARSETS.get(f.encoding, f.encoding).upper() not in BUILT_IN for f in files):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")     # else the reader refuses the GBK family
    width = len(headers)
    groups: dict[tuple, list[tuple[int, str]]] = {}
    for i, f in enumerate(files):
        if f.header:
            groups.setdefault((f.encoding, f.header if header else headers, f.large), []).append((i, f.path))
    frames = [_scan(spark, group, enc, names, headers, header, large) for (enc, names, large), group in groups.items()]
    if not frames:
        schema = StructType([StructField(f"_c{i}", StringType()) for i in range(width)])
        empty = spark.createDataFrame([], schema).withColumns(
            {SOURCE_FILE: F.lit(""), ORDINAL: F.lit(0).cast("long"), RAW_CELLS: F.lit(0), MORE: F.lit(None).cast("array<string>")})
        return RawFrame(empty, list(headers) if header else [])
    raw = frames[0]
    for f in frames[1:]:
        raw = raw.unionByName(f)
    # Drop rows whose cells are all blank
    filled = F.ltrim(F.concat_ws("", *[f"_c{i}" for i in range(width)]), F.lit(WS_CHARS)) != ""     # one test, up to the first character that is not blank
    beyond = F.coalesce(F.exists(MORE, lambda c: F.length(py_strip(c)) > 0), F.lit(False))
    return RawFrame(raw.filter(filled | beyond), list(headers) if header else [])


def _parsed(spark, paths: list[str], charset: str, schema: StructType, header: bool) -> DataFrame:
    """Files that one task each reads: their cells, path and row."""
    df = (spark.read.schema(schema).option("multiLine", True).option("header", header).option("enforceSchema", True)
          .option("encoding", charset).option("escape", '"').option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", _RAW).option("columnPruning", False).option("maxColumns", MAX_COLUMNS).csv(paths))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))      # a file is read by one task, in order
    return df.select("*", F.col("_metadata.file_path").alias(SOURCE_FILE), row.alias("__row"))


def _parsed_in_parts(spark, paths: list[str], charset: str, schema: StructType, header: bool) -> DataFrame:
    """The same of files that many tasks read."""
    options = {"multiLine": "true", "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW,
               "maxColumns": str(MAX_COLUMNS)}
    kind = ", ".join(f"{f.name} string" for f in schema.fields)
    rows = records(spark, paths, charset).withColumn("c", F.from_csv("record", kind, options))
    if header:
        rows = rows.filter("row > 0")
    return rows.select(*[F.col(f"c.{f.name}") for f in schema.fields], F.col("path").alias(SOURCE_FILE),
                       (F.col("row") - int(header)).alias("__row"))


def _scan(spark, group: list[tuple[int, str]], encoding: str, names: tuple, headers: tuple, header: bool,
          large: bool = False) -> DataFrame:
    """Files of one encoding and one header, in the column order of ``headers``."""
    n = len(names)
    schema = StructType([StructField(f"_f{i}", StringType()) for i in range(n)] + [StructField(_RAW, StringType())])
    read = _parsed_in_parts if large else _parsed
    df = read(spark, [p for _, p in group], JAVA_CHARSETS.get(encoding, encoding), schema, header)
    df = df.withColumn(SOURCE_FILE, F.regexp_replace(SOURCE_FILE, "^file:/+", "file:/"))
    uri = spark._jvm.org.apache.hadoop.fs.Path
    order = [(re.sub("^file:/+", "file:/", uri(p).toUri().toString()), i) for i, p in group]
    df = df.join(F.broadcast(spark.createDataFrame(order, f"{SOURCE_FILE} string, __file long")), SOURCE_FILE)  # one row a file
    # Where each column of the first file stands in these files; a name that repeats is taken in order.
    places: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        places.setdefault(name, []).append(i)
    cells = [F.translate(F.col(f"_f{places[h].pop(0)}"), "\t", "").alias(f"_c{k}") for k, h in enumerate(headers)]
    # Never less than 0; the reader refuses to be asked for raw records alone.
    nothing = (F.length(F.coalesce(F.col("_f0"), F.lit(""))) < 0).cast("int")
    # The cells of a raw record are cut out once a row: the generator keeps filters on them from cutting them again.
    cut = F.transform(F.array(F.when(F.col(_RAW).isNotNull(), cells_of(F.col(_RAW)))), lambda every: F.struct(
        F.array_size(every).alias("__n"),
        F.when(F.size(every) > n, F.transform(F.slice(every, n + 1, F.greatest(F.size(every) - n, F.lit(1))),
                                              lambda c: F.translate(c, "\t", ""))).alias(MORE)))
    return df.select("*", F.inline(cut)).select(
        *cells, (F.coalesce("__n", F.lit(n)) + nothing).alias(RAW_CELLS), MORE, SOURCE_FILE,
        (F.shiftleft("__file", FILE_BITS) + F.col("__row")).alias(ORDINAL))
