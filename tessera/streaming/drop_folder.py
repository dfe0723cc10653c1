"""Scheduled import of a drop folder with Structured Streaming.

The original stores a schedule on each data source but runs imports only on
request. This is the Spark way to run the same import continuously: new
delimited files in a folder are picked up by a file stream and each
micro-batch goes through the regular import plan (``import_frame``), which
cleans, classifies and merges it into the target table. The stream's
checkpoint (in the shared checkpoint folder) records which files are done.
``foreachBatch`` may deliver a batch again after a failure; a stored table
(``Catalog.open``) keeps the number of the stream's last batch with each version
and leaves such a batch out, so that no file is imported twice. Other tables
have no such memory: there a repeated batch of a keyless table is appended again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..catalog import Catalog
from ..model import TableSpec
from ..operators.cleaning import ORDINAL
from ..plans.imports import import_frame
from ..session import ensure_checkpoint_dir


def start_folder_import(catalog: Catalog, table: str, folder: str, spec: TableSpec | None = None,
                        checkpoint: str | None = None, available_now: bool = True,
                        results: list | None = None) -> StreamingQuery:
    """Start the stream. Files must carry a header row whose cells are the
    table's column names (label mapping needs the per-file header and is
    done by ``import_files`` for one-off imports). ``results`` collects each
    batch's counters when given."""
    spark = catalog.spark
    spec = spec or catalog.specs[table]
    schema = StructType([StructField(c.name, StringType()) for c in spec.columns])
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{table}"
    stream = (spark.readStream.schema(schema).option("header", True)
              .option("multiLine", True).csv(folder))

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        # ordinal: batch id in the high bits keeps "last row wins" across batches
        df = batch.withColumn(ORDINAL, F.lit(batch_id).cast("long") * F.lit(1 << 40)
                              + F.monotonically_increasing_id())
        out = import_frame(catalog, table, df, spec, batch=(ckpt, batch_id))
        if out is not None and results is not None:
            results.append(out.counters())

    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="1 minute")
    return writer.start()
