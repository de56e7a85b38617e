"""Dense, ordered surrogate ids without a single-partition window.

``row_number().over(Window.orderBy(k))`` moves every row into one task.  This
does the same numbering the distributed way (like ``zipWithIndex`` after a
sort): range-partition on the order key, number rows inside each partition,
and add the partition's offset -- a prefix sum over one small row per
partition.  The order key must be unique.

The range-partitioned rows are checkpointed (written to the shared checkpoint
folder) before numbering: the partition id is then a stored column, so the
per-partition counts and the in-partition numbers come from the very same
partitions, and a lost executor re-reads them instead of re-sampling ranges
over a differently ordered input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def dense_ids(df: DataFrame, order: list[str], id_col: str = "id",
              start: Column | int = 1, partitions: int | None = None) -> DataFrame:
    """Adds ``id_col`` = ``start + rank - 1`` with rank by ``order`` (unique)."""
    ensure_checkpoint_dir(df.sparkSession)
    # Without an explicit count AQE may coalesce adjacent ranges; merged
    # partitions stay in key order, so the offsets below remain valid.
    parted = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranged = parted.withColumn("_pid", F.spark_partition_id()).checkpoint()
    local = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    s = start if isinstance(start, Column) else F.lit(start)
    return (local.join(offsets, "_pid")
            .withColumn(id_col, (s + F.col("_off") + F.col("_r") - 1).cast("long"))
            .drop("_pid", "_r", "_off"))
