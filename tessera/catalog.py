"""Table catalog: logical name -> lazy DataFrame (S6) plus table specs.

Tables are parquet folders, any DataFrame registered by name, or stored tables
(``versions.py``) that later sessions find again through ``Catalog.open``. A name with a
``_N`` suffix is another alias of the same base table, but an exact name is
always looked up first, so a real table called ``sales_2024`` stays reachable.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from .model import TableSpec
from .versions import VersionedTable, names_in

_ALIAS_SUFFIX = re.compile(r"_\d+$")


class CatalogError(ValueError):
    pass


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[str, str] = {}
        self._frames: dict[str, DataFrame] = {}
        self._versioned: dict[str, VersionedTable] = {}
        self.specs: dict[str, object] = {}   # name -> TableSpec (model.py)
        self.root: str | None = None         # of the stored tables

    # -- registration -------------------------------------------------------
    @classmethod
    def from_dir(cls, spark: SparkSession, root: str) -> "Catalog":
        """All ``<name>.parquet`` files and folders below ``root``, in any store
        that Spark reads."""
        cat, at = cls(spark), spark._jvm.org.apache.hadoop.fs.Path(root)
        found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
        for path in sorted(f.getPath().toString() for f in found):
            name = path.rsplit("/", 1)[-1]
            if name.endswith(".parquet"):
                cat.register_path(name.removesuffix(".parquet"), path)
        return cat

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> "Catalog":
        """The stored tables below ``root``, with their names and specifications as
        the last session left them."""
        cat = cls(spark)
        cat.root = root.rstrip("/")
        for folder in names_in(spark, f"{cat.root}/tables"):
            table = VersionedTable(spark, f"{cat.root}/tables/{folder}")
            if not table.dropped:
                cat._versioned[table.name] = table
                cat.specs[table.name] = table.spec
        return cat

    def create(self, spec: TableSpec, schema=None) -> VersionedTable:
        """A new stored table."""
        if self.root is None:
            raise CatalogError("only a catalog opened on a folder can store tables")
        if spec.name in self:
            raise CatalogError(f"table '{spec.name}' exists")
        table = VersionedTable.create(self.spark, f"{self.root}/tables/{uuid.uuid4().hex}", spec, schema)
        self._versioned[spec.name], self.specs[spec.name] = table, table.spec
        return table

    def versioned(self, name: str) -> VersionedTable | None:
        """The stored table of this name, if it is one."""
        return self._versioned.get(self.base_name(name))

    def register_path(self, name: str, path: str) -> None:
        self._paths[name] = path
        self._frames.pop(name, None)

    def register(self, name: str, df: DataFrame, spec=None) -> None:
        self._frames[name] = df
        self._paths.pop(name, None)
        if spec is not None:
            self.specs[name] = spec

    def drop(self, name: str) -> None:
        if name in self._versioned:
            self._versioned.pop(name).refresh().commit(dropped=True)
        self._frames.pop(name, None)
        self._paths.pop(name, None)
        self.specs.pop(name, None)

    def rename(self, old: str, new: str) -> None:
        if new in self:
            raise CatalogError(f"table '{new}' exists")
        if old in self._versioned:
            self._versioned[new] = self._versioned.pop(old).refresh().commit(name=new)
        if old in self._paths:
            self._paths[new] = self._paths.pop(old)
        if old in self._frames:
            self._frames[new] = self._frames.pop(old)
        if old in self.specs:
            self.specs[new] = self.specs.pop(old)

    # -- lookup -------------------------------------------------------------
    def __contains__(self, name: str) -> bool:
        return name in self._paths or name in self._frames or name in self._versioned

    def names(self) -> list[str]:
        return sorted(set(self._paths) | set(self._frames) | set(self._versioned))

    def base_name(self, logical: str) -> str:
        """Exact name first, else strip an alias suffix ``_N``."""
        if logical in self:
            return logical
        base = _ALIAS_SUFFIX.sub("", logical)
        if base in self:
            return base
        raise CatalogError(f"table '{logical}' does not exist")

    def table(self, name: str) -> DataFrame:
        base = self.base_name(name)
        if base in self._versioned:
            return self._versioned[base].refresh().frame()
        df = self._frames.get(base)
        if df is None:
            df = self.spark.read.parquet(self._paths[base])
            self._frames[base] = df
        return df

    def path(self, name: str) -> str | None:
        stored = self._versioned.get(self.base_name(name))
        return stored.path if stored else self._paths.get(self.base_name(name))

    def scan(self, logical: str) -> DataFrame:
        """The base table under its logical alias (``t`` or ``t_1``)."""
        return self.table(logical).alias(logical)

    def columns(self, name: str) -> list[str]:
        return self.table(name).columns
