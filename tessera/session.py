"""Session construction and lineage-cut helpers.

Everything in the library takes a ``SparkSession`` from the caller; this module
only supplies sane defaults for scripts, tests and the benchmark.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults a cluster job would want as well: AQE re-plans joins and partition
# counts from runtime sizes, skew-join splits hot keys, UTC keeps zoneless data
# comparable with external oracles.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def get_session(master: str | None = None, app_name: str = "tessera",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    The cluster's ``spark.checkpoint.dir`` wins. Only when nothing is
    configured (a laptop or a test) a scratch folder is created, and only for a
    local master: a machine-local folder is wrong on a real cluster.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (never a local checkpoint),
    so lost executors recompute from files instead of replaying the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def balance(df: DataFrame, min_partitions: int | None = None,
            key: str | None = "_ordinal") -> DataFrame:
    """Spread a frame that arrives in too few partitions (a multi-line CSV
    file or a one-row-group parquet file cannot be split) over the cluster
    before row-heavy work. Hashing the unique ingest ordinal spreads rows
    evenly and puts a retried task's rows in the same place; without an
    ordinal, round-robin (which sorts first to stay deterministic)."""
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    if key and key in df.columns:
        return df.repartition(target, key)
    return df.repartition(target)


def local_master() -> str:
    return f"local[{os.environ.get('BENCH_CPUS', '8')}]"
