"""Tables that are folders of files as streams, and buckets sized by their input."""

from pyspark.sql import functions as F

from articlespark.plans.registry import load_all
from articlespark.sources import tables
from frames import rows


def _documents(spark, path, n=40, files=3):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("title\ntext "), F.col("id") % 30).alias("text"),
                                 F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).cast("long").alias("n_chars"))
    docs.repartition(files).write.parquet(str(path / "documents.parquet"))


def test_stream_over_a_folder_of_files(spark, tmp_path):
    _documents(spark, tmp_path)
    out = load_all()["stream_ingest"].build(spark, str(tmp_path))
    assert rows(out, "seq") == [(k,) for k in range(30)]


def test_stream_of_events_over_a_folder(spark, tmp_path):
    events = spark.range(20).select(F.col("id").alias("event_id"), F.timestamp_seconds(1704067200 + F.col("id") * 40000).alias("ts"),
                                    F.col("id").alias("user_id"), F.lit("a").alias("event_type"), F.lit(80.0).alias("value"), F.lit(None).cast("string").alias("props"))
    events.repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    assert load_all()["stream_daily"].build(spark, str(tmp_path)).agg(F.sum("total")).first()[0] == 20


def test_buckets_grow_with_the_input(spark, tmp_path, monkeypatch):
    _documents(spark, tmp_path, 2000)
    view = tables.articles_view(spark, str(tmp_path))
    few = tables.bucket_count(view)
    monkeypatch.setattr(tables, "BUCKET_BYTES", 500)
    assert few == 4 < 20 < tables.bucket_count(view)
