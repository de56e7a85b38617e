"""Helpers of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

#: Rows of an Arrow batch at most: whole texts are long.
BATCH_ROWS = 1000


def ready(spark: SparkSession) -> None:
    """Before Python runs in tasks: the package on the workers, small Arrow batches."""
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_ids(df: DataFrame, name: str) -> DataFrame:
    """Number the rows of a stable scan (files, a checkpoint): every read of it, and
    every recomputed task, gives a row the same number."""
    return df.withColumn(name, F.monotonically_increasing_id())


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n (null for a null key)."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))
