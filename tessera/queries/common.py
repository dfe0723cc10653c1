"""Shared helpers for the registered queries (Spark side and oracle side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

from ..catalog import Catalog


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog.from_dir(spark, sf_dir)


def rounded(df: DataFrame, places: int = 2) -> DataFrame:
    """Round every fractional column to ``places`` (as double), so results
    summed in different orders compare equal to the oracle's."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType, DecimalType)):
            c = F.round(c.cast("decimal(38,6)"), places).cast("double").alias(f.name)
        cols.append(c)
    return df.select(*cols)


def R(expr: str, places: int = 2) -> str:
    """Oracle-side twin of ``rounded``: decimal first, then half-up round."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,6)), {places}) AS DOUBLE)"


class Registry:
    """name -> (callable(spark, sf_dir) -> DataFrame, oracle SQL or None)."""

    def __init__(self):
        self.items: dict[str, tuple] = {}

    def add(self, name: str, sql: str | None = None):
        def deco(fn):
            if name in self.items:
                raise KeyError(f"duplicate query '{name}'")
            self.items[name] = (fn, sql)
            return fn
        return deco
