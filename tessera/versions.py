"""Tables as versions over data files that are never rewritten in place.

A table is a folder::

    data/<run>/*.parquet     data files, under column ids that never change
    files/<run>/*.parquet    per version: its data files, their rows and key ranges
    versions/<n>.json        per version: name, columns, specification, where its files are

Writing a version means: new data files, a new list of files, and last the version's
own small file, created only if no other writer has made that number. Readers take
the newest one, so they see all of a version or nothing of it.

* An import rewrites only the files that hold a row it updates (U4); new rows and
  appended files (U6, U7) come as files of their own. Other files keep their names.
* Columns are ids in the files and names in the version: adding, dropping and
  renaming a column (M1-M3) writes no data. Files older than a column read as its
  default.
* The key range of each file lets a reader leave out files that cannot hold a key.
* A version remembers the last batch of each stream that it holds, so a batch that
  is delivered twice is stored once.

The list of files is a Parquet table: it is filtered and joined as one, and only the
names of the files to be read reach the driver, which needs them to plan the scan.
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.types import _parse_datatype_string as parse

from .model import ColumnSpec, TableSpec

FILE = "__file"


class VersionError(ValueError):
    pass


class ConcurrentWrite(VersionError):
    """Another writer has stored this version; read again and repeat."""


# ------------------------------------------------- small files, in any store

def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, p = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that must not exist yet."""
    fs, p = _at(spark, path)
    try:
        stream = fs.create(p, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
            raise ConcurrentWrite(f"{path} exists") from e
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


# ------------------------------------------------------------------ versions

@dataclasses.dataclass
class Column:
    """``id`` is the name in the files; files older than version ``since`` lack it."""
    name: str
    id: str
    type: str
    default: object = None
    since: int = 0


def spec_to_dict(spec: TableSpec) -> dict:
    return dataclasses.asdict(spec)


def spec_from_dict(d: dict) -> TableSpec:
    columns = [ColumnSpec(**{**c, "fk": tuple(c["fk"]) if c.get("fk") else None}) for c in d["columns"]]
    return TableSpec(**{**d, "columns": columns})


class VersionedTable:
    """The newest version of the table below ``path`` as of ``refresh()``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.refresh()

    @classmethod
    def create(cls, spark: SparkSession, path: str, spec: TableSpec, schema: StructType | None = None) -> "VersionedTable":
        """An empty table; ``schema`` if it has more columns than the specification."""
        fields = (schema or spec.struct_type()).fields
        columns = [Column(f.name, f"c{i}", f.dataType.simpleString()) for i, f in enumerate(fields)]
        cls._store(spark, path.rstrip("/"), 0, spec.name, columns, spec, None, {})
        return cls(spark, path)

    def refresh(self) -> "VersionedTable":
        found = names_in(self.spark, f"{self.path}/versions")
        for name in reversed([n for n in found if n.endswith(".json")]):
            text = read_text(self.spark, f"{self.path}/versions/{name}")
            if not text.endswith("\n"):
                continue        # its writer has not finished
            self._load(json.loads(text))
            return self
        raise VersionError(f"no table in {self.path}")

    def at(self, version: int) -> "VersionedTable":
        old = object.__new__(VersionedTable)
        old.spark, old.path = self.spark, self.path
        old._load(json.loads(read_text(self.spark, f"{self.path}/versions/{version:08d}.json")))
        return old

    def _load(self, d: dict) -> None:
        self.version, self.name, self.listing, self.batches = d["version"], d["name"], d["listing"], d["batches"]
        self.columns = [Column(**c) for c in d["columns"]]
        self.spec = spec_from_dict(d["spec"])
        self.dropped = d["dropped"]

    @staticmethod
    def _store(spark, path, version, name, columns, spec, listing, batches, dropped=False) -> None:
        body = {"version": version, "name": name, "columns": [dataclasses.asdict(c) for c in columns],
                "spec": spec_to_dict(spec), "listing": listing, "batches": batches, "dropped": dropped}
        create_text(spark, f"{path}/versions/{version:08d}.json", json.dumps(body, default=str) + "\n")

    # ------------------------------------------------------------------ read

    @property
    def range_column(self) -> Column | None:
        key = self.spec.key()
        return next((c for c in self.columns if key and c.name == key[0]), None)

    def schema(self) -> StructType:
        return StructType([StructField(c.name, parse(c.type)) for c in self.columns])

    def files(self, low=None, high=None) -> DataFrame:
        """``file, rows, low, high, version``; with bounds, only files that may hold a key between them."""
        key = self.range_column
        kind = key.type if key else "string"
        fields = f"file string, rows long, low {kind}, high {kind}, version long"
        if self.listing is None:
            return self.spark.createDataFrame([], fields)
        out = self.spark.read.schema(fields).parquet(self.listing)
        if key and low is not None:
            out = out.filter((F.col("high") >= F.lit(low)) & (F.col("low") <= F.lit(high)))
        return out

    def frame(self, files: DataFrame | None = None, with_file: bool = False) -> DataFrame:
        """The rows, of all files or of those in ``files`` (rows of ``self.files()``)."""
        listed = (self.files() if files is None else files).select("file", "version").collect()
        late = sorted({c.since for c in self.columns if c.since})
        parts: dict[int, list[str]] = {}
        for r in listed:        # files that lack the same columns
            parts.setdefault(sum(r["version"] >= v for v in late), []).append(unquote(r["file"]))
        out = None
        for k, names in sorted(parts.items()):
            known = {c.id for c in self.columns if not c.since or late.index(c.since) < k}
            physical = StructType([StructField(c.id, parse(c.type)) for c in self.columns if c.id in known])
            df = self.spark.read.schema(physical).parquet(*names)
            cols = [(F.col(c.id) if c.id in known else F.lit(c.default).cast(c.type)).alias(c.name) for c in self.columns]
            part = df.select(*cols, *([F.col("_metadata.file_path").alias(FILE)] if with_file else []))
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = self.spark.createDataFrame([], self.schema())
            out = out.withColumn(FILE, F.lit(None).cast("string")) if with_file else out
        return out

    # ----------------------------------------------------------------- write

    def commit(self, rows: DataFrame | None = None, replaced: DataFrame | None = None,
               batch: tuple[str, int] | None = None, columns: list[Column] | None = None,
               spec: TableSpec | None = None, name: str | None = None, dropped: bool = False) -> "VersionedTable":
        """The next version: ``rows`` as new files, in place of those in ``replaced``
        (``file``), with changed columns or another name."""
        run, n, key = uuid.uuid4().hex, self.version + 1, self.range_column
        listing = self.listing
        if rows is not None:
            to = f"{self.path}/data/{run}"
            data = rows.select(*[F.col(f"`{c.name}`").cast(c.type).alias(c.id) for c in self.columns])
            if key:     # files of narrow key ranges
                data = data.repartitionByRange(F.col(key.id)).sortWithinPartitions(key.id)
            data.write.parquet(to)
            found = self.spark.read.schema(data.schema).parquet(to)
            bound = F.col(key.id) if key else F.lit(None).cast("string")
            new = (found.groupBy(F.col("_metadata.file_path").alias("file"))
                   .agg(F.count("*").alias("rows"), F.min(bound).alias("low"), F.max(bound).alias("high"))
                   .withColumn("version", F.lit(n).cast("long")))
            kept = self.files()
            if replaced is not None:
                kept = kept.join(replaced.select("file"), "file", "left_anti")
            listing = f"{self.path}/files/{run}"
            kept.unionByName(new).write.parquet(listing)
        batches = dict(self.batches, **({batch[0]: batch[1]} if batch else {}))
        self._store(self.spark, self.path, n, name or self.name, columns or self.columns, spec or self.spec,
                    listing, batches, dropped)
        return self.refresh()

    def holds(self, batch: tuple[str, int] | None) -> bool:
        """Has this batch of its stream been stored already?"""
        return batch is not None and self.batches.get(batch[0], -1) >= batch[1]

    # --------------------------------------------------------------- columns

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise VersionError(f"no column '{name}'")

    def add_column(self, col: ColumnSpec) -> "VersionedTable":
        """M1: files so far read as the default."""
        if col.primary_key:
            raise VersionError("a new column cannot be the primary key")
        if any(c.name == col.name for c in self.columns):
            raise VersionError(f"column '{col.name}' exists")
        if not col.nullable and col.default is None:
            raise VersionError("a required new column needs a default")
        used = [int(c.id[1:]) for v in range(self.version + 1) for c in self.at(v).columns]
        kind = parse(col.spark_type()).simpleString()
        new = Column(col.name, f"c{max(used, default=-1) + 1}", kind, col.default, self.version + 1)
        spec = dataclasses.replace(self.spec, columns=[*self.spec.columns, col])
        return self.commit(columns=[*self.columns, new], spec=spec)

    def drop_column(self, name: str) -> "VersionedTable":
        """M2: the files keep it under an id that no version from now on names."""
        self.column(name)
        if name in (self.spec.key() or []):
            raise VersionError(f"'{name}' is part of the key")
        spec = dataclasses.replace(self.spec, columns=[c for c in self.spec.columns if c.name != name])
        return self.commit(columns=[c for c in self.columns if c.name != name], spec=spec)

    def rename_column(self, old: str, new: str) -> "VersionedTable":
        """M3: another name for the same id."""
        self.column(old)
        if any(c.name == new for c in self.columns):
            raise VersionError(f"column '{new}' exists")
        swap = lambda c: dataclasses.replace(c, name=new) if c.name == old else c       # noqa: E731
        spec = dataclasses.replace(self.spec, columns=[swap(c) for c in self.spec.columns],
                                   upsert_key=[new if k == old else k for k in self.spec.upsert_key] if self.spec.upsert_key else None)
        return self.commit(columns=[swap(c) for c in self.columns], spec=spec)


# ---------------------------------------------------------------------- jobs

JOB = ("id string, table string, source_id string, created_at timestamp_ntz, version long, total_rows long, "
       "rows_inserted long, rows_updated long, rows_skipped long, rows_rejected long")


class JobLog:
    """One stored row per import, and the rows it rejected."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def record(self, run: str, table: str, counters: dict, rejects: DataFrame, version: int | None = None,
               source_id: str | None = None) -> None:
        """Rejects first: a job that is listed has its rejects. A run that is recorded
        again replaces its own."""
        rejects.write.mode("overwrite").parquet(f"{self.path}/rejects/run={run}")
        row = self.spark.range(1).select(
            F.lit(run).alias("id"), F.lit(table).alias("table"), F.lit(source_id).cast("string").alias("source_id"),
            F.localtimestamp().cast("timestamp_ntz").alias("created_at"), F.lit(version).cast("long").alias("version"),
            *[F.lit(counters[c]).cast("long").alias(c) for c in
              ("total_rows", "rows_inserted", "rows_updated", "rows_skipped", "rows_rejected")])
        row.write.mode("overwrite").parquet(f"{self.path}/jobs/run={run}")

    def jobs(self) -> DataFrame:
        if not names_in(self.spark, f"{self.path}/jobs"):
            return self.spark.createDataFrame([], JOB)
        return self.spark.read.schema(JOB).parquet(f"{self.path}/jobs/run=*")

    def rejects(self, run: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rejects/run={run}")
