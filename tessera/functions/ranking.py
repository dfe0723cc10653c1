"""Positions within groups without putting a group into one task.

``row_number() OVER (PARTITION BY g ORDER BY v)`` sends every row of a group
to one task: a category holding a third of the data would land on one core.
``positions`` instead

1. range-partitions on (group, order keys, row hash), so a hot group is cut into
   many ordered slices, rows that tie on the order keys too, and sorts each slice;
2. numbers the rows of each slice with ``monotonically_increasing_id`` in the
   same task (partition index in the high bits, row number in the low bits) and
   writes the result to the checkpoint folder. It is read twice from there, so
   both readers see the same slices whatever columns they need;
3. takes, per (slice, group), the first id and the row count - a frame of at
   most slices x groups rows - and turns the counts into running offsets;
4. adds them back: ``pos = offset + (id - first id)``.

The result is the exact 0-based position of every row in its group plus the
group size ``n``; everything stays in the JVM. Rows that tie on all order keys
come in the order of their hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

POS, SIZE = "__pos", "__n"
_ID, _PID = "__id", "__pid"


def positions(df: DataFrame, group_cols: list[str], order: list[Column],
              num_partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """``df`` plus ``__pos`` (0-based rank in its group under ``order``) and
    ``__n`` (group size). Group keys must be non-null (normalise first). With
    ``weight`` each row stands for that many equal ones: ``__pos`` is the rank of
    the first of them and ``__n`` the sum."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group_cols] + list(order) + [F.xxhash64(*df.columns)]
    numbered = cut_lineage(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                           .withColumn(_ID, F.monotonically_increasing_id())
                           .withColumn(_PID, F.shiftright(F.col(_ID), 33)))
    rows = F.col(weight) if weight else F.lit(1)
    slices = numbered.groupBy(_PID, *group_cols).agg(F.min(_ID).alias("__first"), F.sum(rows).alias("__cnt"))
    earlier = Window.partitionBy(*group_cols).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (slices.withColumn("__off", F.coalesce(F.sum("__cnt").over(earlier), F.lit(0)))
               .withColumn(SIZE, F.sum("__cnt").over(Window.partitionBy(*group_cols))).drop("__cnt"))
    out = numbered.join(offsets, [_PID, *group_cols])
    before = F.col(_ID) - F.col("__first")
    if weight:      # a window within one slice of one group
        inside = Window.partitionBy(_PID, *group_cols).orderBy(_ID).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum(weight).over(inside), F.lit(0))
    return out.withColumn(POS, (F.col("__off") + before).cast("long")).drop("__off", "__first", _ID, _PID)
