"""Saved views (V31) and import history.

Saved view configs are rows of a small parquet table (name, config JSON,
created/updated time). They are metadata, not data: listing and loading them
reads that table only; running one compiles the config into a plan over the
data tables.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ViewConfig
from ..operators.evolution import config_text
from .view import compile_view

VIEWS_SCHEMA = ("name string, description string, config_json string, "
                "created_at timestamp_ntz, updated_at timestamp_ntz")


class SavedViewError(ValueError):
    pass


class ViewStore:
    """Views kept as an append-only table below ``path``: every save adds one
    row, the newest row of a name is the view. A store opened later on the same
    path sees them all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def frame(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], VIEWS_SCHEMA)
        fields = [c.split()[0] for c in VIEWS_SCHEMA.split(", ")]
        newest = (self.spark.read.schema(f"{VIEWS_SCHEMA}, version long").parquet(self.path).groupBy("name")
                  .agg(F.max_by(F.struct(*fields[1:], "version"), "version").alias("v")))
        return newest.select("name", *[F.col(f"v.{c}").alias(c) for c in fields[1:]], F.col("v.version"))

    def save(self, name: str, cfg, description: str | None = None,
             now: dt.datetime | None = None, replace: bool = False) -> None:
        """Store ``cfg`` under a unique name (``replace`` updates it)."""
        ViewConfig.from_dict(cfg) if isinstance(cfg, dict) else cfg   # validates shape
        now = now or dt.datetime.now().replace(microsecond=0)
        old = []
        if self._exists():
            old = self.frame().filter(F.col("name") == name).select("created_at", "version").collect()
        if old and not replace:
            raise SavedViewError(f"a view named '{name}' exists")
        created, version = (old[0]["created_at"], old[0]["version"] + 1) if old else (now, 1)
        self.spark.createDataFrame([(name, description, config_text(cfg), created, now, version)],
                                   f"{VIEWS_SCHEMA}, version long").coalesce(1).write.mode("append").parquet(self.path)

    def list(self, sort: str = "created_at", descending: bool = True) -> DataFrame:
        """Views newest first, or by created/updated time either way."""
        if sort not in ("created_at", "updated_at"):
            raise SavedViewError("sort by created_at or updated_at")
        col = F.col(sort).desc() if descending else F.col(sort).asc()
        return self.frame().select("name", "description", "created_at", "updated_at") \
            .orderBy(col, F.col("name"))

    def load(self, name: str) -> ViewConfig:
        rows = self.frame().filter(F.col("name") == name).select("config_json").collect()
        if not rows:
            raise SavedViewError(f"no view named '{name}'")
        return ViewConfig.from_dict(json.loads(rows[0]["config_json"]))

    def run(self, catalog, name: str) -> DataFrame:
        return compile_view(catalog, self.load(name))


def import_history(jobs: DataFrame, sources: DataFrame, page: int = 1, size: int = 20
                   ) -> tuple[DataFrame, DataFrame]:
    """Import jobs with their source, newest first, one page, plus the
    total as a one-row frame. ``jobs`` has ``id, source_id, created_at`` and
    the counters; ``sources`` has ``id, name, source_type``."""
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"),
                       "source_type")
    j = jobs.join(s, "source_id", "left")
    page_df = j.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()) \
               .offset((max(1, page) - 1) * size).limit(size)
    return page_df, jobs.agg(F.count(F.lit(1)).alias("total"))
