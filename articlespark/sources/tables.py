"""Table sources: parquet scans, declared schemas and the test-data adapters.

The driver's test data has no ``articles`` table, so ``articles_view`` derives
one deterministically from ``documents`` (same rule in the SQL oracle):

* id = doc_id, title = first line of text, content = text,
  source = source, category = lang
* date = 2024-01-01 00:00 UTC + doc_id hours
* sentiment_score = ((doc_id * 37) % 201 - 100) / 100  (integers first)

``events_view`` maps the event stream to scored, timestamped rows with
score = (value - 50) / 100.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_line

EPOCH_2024 = 1704067200  # 2024-01-01T00:00:00Z

RAW_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("date", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
])

SOURCES_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
])

ARTICLES_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("source_id", T.LongType()),
    T.StructField("alt_sources", T.StringType()),
    T.StructField("date", T.TimestampType()),
    T.StructField("category", T.StringType()),
    T.StructField("sentiment_score", T.DoubleType()),
])

ENRICHED_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("date", T.TimestampType()),
    T.StructField("category", T.StringType()),
    T.StructField("sentiment_score", T.DoubleType()),
])

KEYWORDS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("keyword", T.StringType(), False),
])

ARTICLE_KEYWORDS_SCHEMA = T.StructType([
    T.StructField("article_id", T.LongType()),
    T.StructField("keyword_id", T.LongType()),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A missing store reads as an empty frame with the declared schema."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    if not fs.exists(jvm_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_raw_batch(spark: SparkSession, path: str) -> DataFrame:
    """A raw batch (JSON Lines) with the declared schema: fields that a record lacks are
    NULL, others are ignored; a batch that is not there is empty."""
    jp = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    if not jp.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jp):  # noqa: SLF001
        return spark.createDataFrame([], RAW_SCHEMA)
    return spark.read.schema(RAW_SCHEMA).json(path)


def insert_defaults(df: DataFrame) -> DataFrame:
    """what an inserted article has where the record has nothing: content_hash and
    alt_sources '', score 0.0, url NULL."""
    held = set(df.columns)
    out = df if "url" in held else df.withColumn("url", F.lit(None).cast("string"))
    for name, default in (("content_hash", F.lit("")), ("alt_sources", F.lit("")), ("sentiment_score", F.lit(0.0))):
        out = out.withColumn(name, F.coalesce(F.col(name), default) if name in held else default)
    return out


#: Bytes of the files of one bucket, about.
BUCKET_BYTES = 16 << 20


def bucket_count(df: DataFrame) -> int:
    """As many buckets as the scan of ``df`` has ``BUCKET_BYTES``, so that a task that sorts one
    needs the same memory at any size; at least one for each core."""
    size = int(df._jdf.queryExecution().optimizedPlan().collectLeaves().head().stats().sizeInBytes())  # noqa: SLF001
    return max(4, df.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str) -> DataFrame:
    """A table bucketed and sorted by ``key``: joins and aggregates by it need no exchange of it."""
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def articles_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched articles (``id, title, content, source, date, category,
    sentiment_score``) derived from ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        first_line("text").alias("title"),
        F.col("text").alias("content"),
        F.col("source"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("doc_id") * 3600).alias("date"),
        F.col("lang").alias("category"),
        (((F.col("doc_id") * 37) % 201 - 100) / 100.0).alias("sentiment_score"),
    )


def raw_batch_view(spark: SparkSession, sf_dir: str, title: str = "first_line") -> DataFrame:
    """Raw crawled records (RAW_SCHEMA) derived from ``documents``.

    ``title="first_line"`` uses the headline rule of ``articles_view``;
    ``title="unique"`` uses ``source || ' ' || doc_id`` so that the title pass
    of the exact dedupe removes nothing and the hash pass does the work.
    """
    docs = read_table(spark, sf_dir, "documents")
    title_col = (first_line("text") if title == "first_line"
                 else F.concat_ws(" ", F.col("source"), F.col("doc_id").cast("string")))
    return docs.select(
        F.col("doc_id").alias("seq"),
        title_col.alias("title"),
        F.lit(None).cast("string").alias("url"),
        F.col("text").alias("content"),
        F.col("lang").alias("category"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("doc_id") * 3600).alias("date"),
        F.col("source"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example")).alias("source_url"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("doc_id") * 3600).alias("ingested_at"),
    )


def events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored, timestamped rows: ``event_id, ts, source, score``."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "ts", F.col("event_type").alias("source"),
        ((F.col("value") - 50) / 100.0).alias("score"),
    )
