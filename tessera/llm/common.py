"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir, scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prefix(df: DataFrame) -> str:
    """Underscores that no column of ``df`` begins with: names that start with them are free."""
    p = "_"
    while any(c.startswith(p) for c in df.columns):
        p += "_"
    return p


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: the plan that follows starts from files every executor can see, so a
    lost executor costs a re-read and not the work before it."""
    ensure_checkpoint_dir(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is the same for pure ASCII and far
    cheaper than ``translate``, which looks every character up."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
            .otherwise(F.translate(text, UPPER, UPPER.lower()))
