"""Structured Streaming forms of ingest and the live dashboard.

* ``stream_exact_ingest`` (X1 + X2 + D1/D4 core): a file-source stream of raw
  records; each micro-batch keeps the first row per content hash (by ``seq``)
  and appends only hashes the store does not hold yet.  The store table *is*
  the dedupe state.  Each micro-batch owns one folder, named by its feed (the id
  that the checkpoint holds) and batch id: a replay replaces it, and other
  feeds, or the same one after its checkpoint was lost, can't touch it.  The
  store read is limited to the dedupe horizon (a filter on ``ingest_day``).
* ``stream_into_store`` (X1 + D3): the whole ingest of each micro-batch as one commit of
  the versioned article store (``sources/versions.py``).
* ``dedupe_within_watermark`` (X2, state-store form): Spark's
  ``dropDuplicatesWithinWatermark`` on the content hash; state is bounded by
  the watermark instead of re-reading stored hashes.
* ``stream_daily_sentiment`` (X3): every micro-batch writes its own sums for
  each day it has rows of, and ``latest_windows`` adds them up, so rows count
  however late they come and no state is held.  ``daily_window_agg`` is the
  form with a watermark, which drops rows that are later.
* ``snapshot_digest`` / ``changed_rows`` (X4): an order-independent digest of
  a snapshot and a per-row change feed, for "re-render only when changed".

All outputs go under the shared checkpoint folder (``spark.checkpoint.dir``),
never a machine-local temp folder.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import content_hash
from ..operators.dedupe import keep_first
from ..operators.ingest import ingest_into
from ..session import ensure_checkpoint_dir, scratch_path
from ..sources.versions import ArticleStore

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def _path_exists(spark: SparkSession, path: str) -> bool:
    jp = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return jp.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jp)  # noqa: SLF001


def file_stream(spark: SparkSession, directory: str, schema: T.StructType, glob: str | None = None,
                fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A file-source stream (new files in ``directory`` become micro-batches)."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(directory)


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType) -> DataFrame:
    """X1 over a table of the driver: the files of its folder, or the one file that it is."""
    jp = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")  # noqa: SLF001
    status = jp.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jp)  # noqa: SLF001
    return (file_stream(spark, f"{sf_dir}/{name}.parquet", schema) if status.isDirectory()
            else file_stream(spark, sf_dir, schema, glob=f"{name}.parquet"))


def feed_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps in a checkpoint: the same after a restart, new
    where the checkpoint is new."""
    return json.loads("".join(r[0] for r in spark.read.text(f"{checkpoint}/metadata").collect()))["id"]


def _batch_path(spark: SparkSession, out_path: str, checkpoint: str, batch_id: int) -> str:
    """The folder that one micro-batch of one feed owns: a replay replaces it, and
    no other feed or checkpoint (whose batch ids start at 0 again) writes to it."""
    return f"{out_path}/feed={feed_id(spark, checkpoint)}/batch_id={batch_id}"


def stream_exact_ingest(raw_stream: DataFrame, store_path: str, checkpoint: str,
                        horizon_days: int = 3, available_now: bool = True,
                        processing_time: str | None = None):
    """Run the exact-dedupe ingest stream into ``store_path``.

    ``raw_stream`` carries ``seq, title, content, source, ingested_at``; rows
    without a time are compared with the whole store, and stored ones with every
    batch.  Feeds may share a store if they run one after another.
    Returns the started query (already finished when ``available_now``).
    """
    spark = raw_stream.sparkSession

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        b = batch.withColumn("content_hash", content_hash("content"))
        b = keep_first(b, ["content_hash"], "seq").withColumn("ingest_day", F.to_date("ingested_at"))
        if _path_exists(spark, store_path):
            lo, timeless = b.agg(F.date_sub(F.min("ingest_day"), horizon_days), F.count_if(F.col("ingest_day").isNull())).first()
            own = (F.col("feed") == feed_id(spark, checkpoint)) & (F.col("batch_id") == batch_id)
            known = spark.read.schema("content_hash string, ingest_day date, feed string, batch_id long").parquet(store_path).where(~own)
            if lo is not None and not timeless:
                known = known.where((F.col("ingest_day") >= lo) | F.col("ingest_day").isNull())
            b = b.join(known.select("content_hash"), "content_hash", "left_anti")
        b.write.mode("overwrite").parquet(_batch_path(spark, store_path, checkpoint, batch_id))

    w = raw_stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "30 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def stream_into_store(raw_stream: DataFrame, store_path: str, checkpoint: str, now=None, horizon_hours: float | None = 72,
                      threshold: float = 0.85, available_now: bool = True, processing_time: str | None = None):
    """X1 + D3: every micro-batch of raw records (RAW_SCHEMA) is one commit of the article
    store: exact and fuzzy dedupe, alt_sources, source dimension and upsert.  The commit
    record holds the feed's last batch, so one that Spark replays changes nothing.
    ``now=None``: each batch looks back from its newest ``ingested_at``."""
    spark = raw_stream.sparkSession
    store = ArticleStore(spark, store_path)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        ingest_into(store, batch, now, horizon_hours, threshold, feed=feed_id(spark, checkpoint), batch_id=batch_id)

    w = raw_stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "30 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def dedupe_within_watermark(raw_stream: DataFrame, horizon: str = "72 hours",
                            event_time: str = "ingested_at") -> DataFrame:
    """X2 with Spark's state store: drop rows whose content hash was already
    seen within ``horizon`` of event time.  State is bounded by the watermark;
    which copy survives inside one micro-batch is Spark's choice (use
    ``stream_exact_ingest`` for the keep-first-by-seq rule)."""
    return (raw_stream.withColumn("content_hash", content_hash("content"))
            .withWatermark(event_time, horizon)
            .dropDuplicatesWithinWatermark(["content_hash"]))


def daily_window_agg(scored: DataFrame, ts: str = "ts", score: str = "score",
                     watermark: str = "3 days") -> DataFrame:
    """X3 with a watermark: running per-day sums for A4 over a stream."""
    return (scored.withWatermark(ts, watermark)
            .groupBy(F.window(ts, "1 day").alias("w")).agg(*_sums(F.col(score))))


def _sums(s: Column) -> list[Column]:
    return [F.sum(s).alias("score_sum"), F.count(s).alias("total"),
            F.count_if(s > 0.1).alias("pos"), F.count_if(s < -0.1).alias("neg")]


def stream_daily_sentiment(scored_stream: DataFrame, out_path: str, checkpoint: str,
                           available_now: bool = True, refresh: str = "30 seconds"):
    """``scored_stream`` (``ts, score``) as one row of sums per micro-batch and
    day; rows without a time are left out."""
    spark = scored_stream.sparkSession

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.where("ts IS NOT NULL").groupBy(F.to_date("ts").alias("day")).agg(*_sums(F.col("score")))
         .write.mode("overwrite").parquet(_batch_path(spark, out_path, checkpoint, batch_id)))

    w = scored_stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=refresh)
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def latest_windows(spark: SparkSession, out_path: str) -> DataFrame:
    """The days written by ``stream_daily_sentiment``, over all its micro-batches."""
    parts = spark.read.parquet(out_path)
    days = parts.groupBy("day").agg(*(F.sum(c).alias(c) for c in ("score_sum", "total", "pos", "neg")))
    return days.select(
        "day", (F.col("score_sum") / F.col("total")).alias("avg_score"), "pos", "neg", "total",
        F.try_divide(F.col("pos"), F.col("total")).alias("pos_ratio"),
        F.try_divide(F.col("neg"), F.col("total")).alias("neg_ratio"))


def row_hash(cols: Sequence[str | Column]) -> Column:
    """A 60-bit row fingerprint (first 15 hex digits of SHA-256 over the
    \\x01-joined values; NULL rendered as \\x02)."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\x02")) for c in cols]
    return F.conv(F.substring(F.sha2(F.concat_ws("\x01", *parts), 256), 1, 15), 16, 10).cast("decimal(20,0)")


def snapshot_digest(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(n_rows, digest)`` -- independent of row order and partitioning;
    two snapshots with equal digests are treated as unchanged."""
    cols = list(cols or df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.coalesce(F.sum(row_hash(cols)), F.lit(0)).cast("string").alias("digest"))


def changed_rows(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """X4 change feed: rows of ``new`` that are added or changed vs ``old``
    (``change_feed`` reports deleted keys too)."""
    cols = [c for c in new.columns]
    o = old.select(*key, row_hash(cols).alias("_h"))
    return new.withColumn("_h", row_hash(cols)).join(o, [*key, "_h"], "left_anti").drop("_h")


#: Folders of a snapshot, whatever its size: a large one becomes several files.
SNAPSHOT_FOLDERS = 64


def write_snapshot(df: DataFrame, path: str, part: Column) -> None:
    """A snapshot by ``part`` (a range or bucket of its key), with the rows' count and digest of
    each part beside it.  Parts share ``SNAPSHOT_FOLDERS`` folders, so that files do not grow in
    number with the parts."""
    cols = df.columns
    dealt = df.withColumn("part", part).withColumn("part_folder", F.pmod(F.xxhash64("part"), F.lit(SNAPSHOT_FOLDERS)).cast("int"))
    dealt.hint("rebalance", "part_folder").write.partitionBy("part_folder").mode("overwrite").parquet(f"{path}/rows")
    stored = df.sparkSession.read.parquet(f"{path}/rows")
    digests = stored.groupBy("part_folder", "part").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row_hash(cols)).cast("string").alias("digest"))
    digests.write.mode("overwrite").parquet(f"{path}/digests")


def _differing(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(folder, part) whose digests differ, or that one snapshot has alone."""
    a, b = (spark.read.parquet(f"{p}/digests").select("part_folder", "part", F.struct("n_rows", "digest").alias(n)) for p, n in ((old, "a"), (new, "b")))
    both = a.join(b, a["part_folder"].eqNullSafe(b["part_folder"]) & a["part"].eqNullSafe(b["part"]), "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(F.coalesce(a["part_folder"], b["part_folder"]).alias("part_folder"),
                                                                 F.coalesce(a["part"], b["part"]).alias("part"))


def changed_parts(spark: SparkSession, old: str, new: str) -> list:
    """The parts whose digests differ, or that one snapshot has alone."""
    return sorted(r[0] for r in _differing(spark, old, new).select("part").collect())


def change_feed(spark: SparkSession, old: str, new: str, key: Sequence[str]) -> DataFrame:
    """``(change, <columns>)`` between two written snapshots, change = insert, update or
    delete (the old row).  Only folders that hold parts with another digest are read, and only those
    parts are compared.  Keys are unique."""
    ensure_checkpoint_dir(spark)
    parts = _differing(spark, old, new).checkpoint()
    folders = sorted(r[0] for r in parts.select("part_folder").distinct().collect())
    a, b = (spark.read.parquet(f"{p}/rows").where(F.col("part_folder").isin(folders)).drop("part_folder")
            .join(parts.select("part"), "part", "left_semi").drop("part") for p in (old, new))
    cols = [c for c in b.columns if c not in key]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, F.struct(*cols).alias(name), row_hash([*key, *cols]).alias(f"{name}_hash"))

    both = side(a, "_old").join(side(b, "_new"), list(key), "full").where(~F.col("_old_hash").eqNullSafe(F.col("_new_hash")))
    change = F.when(F.col("_old_hash").isNull(), "insert").when(F.col("_new_hash").isNull(), "delete").otherwise("update")
    return both.select(change.alias("change"), *key, F.coalesce("_new", "_old").alias("_row")).select("change", *key, "_row.*")


def run_dir(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh (output, checkpoint) folders under the shared checkpoint folder."""
    base = scratch_path(spark, name)
    return f"{base}/out", f"{base}/_checkpoint"
