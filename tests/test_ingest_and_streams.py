import os
import sys

from pyspark.sql import functions as F

from articlespark.functions.sentiment import lexicon_frame, score_lexicon, score_with, sentiment_label
from articlespark.sources.extract import SITE_RULES, extract_articles, parse_page
from frames import rows

SITE_A = ('<article class="item-news"><h3 class="title-news"><a href="https://example.org/canal">Lock gates repaired</a></h3>'
          '<p class="description"><a href="https://example.org/canal">Boats pass again from Monday</a></p></article>')
SITE_A_NO_DESC = '<article class="item-news"><h3 class="title-news"><a href="https://example.org/canal">T</a></h3></article>'
SITE_B = '<div data-testid="edgel"><h2>Glacier survey</h2><p>Teams map the ice</p></div>'
SITE_B_LINK = '<div data-testid="edgel"><h2>Only  title</h2><a href="/x">more</a></div>'


def test_parse_rules():
    assert parse_page(SITE_A, SITE_RULES) == [(0, 0, "Lock gates repaired", "https://example.org/canal", "Boats pass again from Monday")]
    assert parse_page(SITE_A_NO_DESC, SITE_RULES) == []
    assert parse_page(SITE_B, SITE_RULES) == [(0, 1, "Glacier survey", "", "Teams map the ice")]


def test_extract_articles(spark):
    pages = spark.createDataFrame([(1, "u1", SITE_A), (2, "u2", SITE_B), (3, "u3", SITE_B_LINK)],
                                  "page_id long, url string, html string")
    out = extract_articles(pages).orderBy("page_id").collect()
    assert [(r.title, r.url, r.content, r.category, r.source) for r in out] == [
        ("Lock gates repaired", "https://example.org/canal", "Boats pass again from Monday", "News", "VnExpress"),
        ("Glacier survey", "", "Teams map the ice", "World", "BBC"),
        ("Only title", "https://www.bbc.com/x", "No description", "World", "BBC")]


def test_html_entities_script_and_unclosed_p():
    from articlespark.sources.extract import PAGE_RULE

    html = ('<script>var t="</p>";</script><article><h1>A &amp; B</h1>'
            '<p><b>Lead<br><p>Body &quot;x&quot;</p></article>')
    assert parse_page(html, [PAGE_RULE]) == [(0, 0, "A & B", None, "Lead Body \"x\"")]


def test_labels(spark):
    df = spark.createDataFrame([(0.5,), (0.0,), (-0.2,), (0.1,), (-0.1,), (None,)], "s double")
    got = [r[0] for r in df.select(sentiment_label("s")).collect()]
    assert got == ["positive", "neutral", "negative", "neutral", "neutral", "neutral"]
    got = [r[0] for r in df.select(sentiment_label("s", nulls="none")).collect()]
    assert got[-1] is None
    got = [r[0] for r in df.select(sentiment_label("s", 0.2, nulls="zero")).collect()]
    assert got == ["positive", "neutral", "neutral", "neutral", "neutral", "neutral"]


def test_plugin_scorer(spark):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def stub(s: pd.Series) -> pd.Series:
        assert not s.isna().any() and (s != "").all()
        return pd.Series([0.8] * len(s))

    df = spark.createDataFrame([(1, "text"), (2, None), (3, "")], "id long, content string")
    assert rows(score_with(df, stub), "id", "sentiment_score") == [(1, 0.8), (2, 0.0), (3, 0.0)]


def test_lexicon_scorer(spark):
    df = spark.createDataFrame([(1, "good good bad"), (2, "nothing here"), (3, None)], "id long, content string")
    out = dict(rows(score_lexicon(df, lexicon_frame(spark)), "id", "sentiment_score"))
    assert abs(out[1] - (0.7 + 0.7 - 0.7) / 3) < 1e-12 and out[2] == 0.0 and out[3] == 0.0


def test_stream_equals_batch(spark, tmp_path):
    from articlespark.plans.registry import load_all

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    reg = load_all()
    sf = "/root/testdata/sf0.001"
    a = rows(reg["stream_daily"].build(spark, sf))
    b = rows(reg["daily_sentiment_ratio"].build(spark, sf))
    assert a == b and len(a) > 0
    ingest = rows(reg["stream_ingest"].build(spark, sf))
    from articlespark.operators.dedupe import keep_first
    from articlespark.functions.text import content_hash
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("seq"), content_hash("text").alias("content_hash"))
    assert ingest == rows(keep_first(docs, ["content_hash"], "seq"))


def test_snapshot_digest_detects_change(spark):
    from articlespark.streaming.ingest import changed_rows, snapshot_digest

    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "id long, v string")
    c = spark.createDataFrame([(1, "x"), (2, "z")], "id long, v string")
    assert snapshot_digest(a).first() == snapshot_digest(b).first()
    assert snapshot_digest(a).first() != snapshot_digest(c).first()
    assert rows(changed_rows(a, c, ["id"])) == [(2, "z")]


def test_stream_ingest_replay_is_idempotent(spark, tmp_path):
    from articlespark.streaming import ingest as st

    src = tmp_path / "raw"
    rows_in = [(1, "a", "same text", "BBC"), (2, "b", "same  text", "CNN"), (3, "c", "other", "AP")]
    spark.createDataFrame(rows_in, "seq long, title string, content string, source string") \
        .withColumn("ingested_at", F.to_timestamp(F.lit("2024-01-01 00:00:00"))) \
        .coalesce(1).write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    store = str(tmp_path / "store")
    for attempt in range(2):  # the second run replays batch 0 with a fresh checkpoint
        stream = st.file_stream(spark, str(src), schema)
        st.stream_exact_ingest(stream, store, str(tmp_path / f"ckpt{attempt}"))
        got = rows(spark.read.parquet(store), "seq")
        assert got == [(1,), (3,)], attempt


def test_dedupe_within_watermark(spark, tmp_path):
    from articlespark.streaming import ingest as st

    src = tmp_path / "raw"
    data = [(1, "x", "same text", "2024-01-01 00:00:00"), (2, "y", "same  text", "2024-01-01 01:00:00"),
            (3, "z", "other", "2024-01-01 02:00:00")]
    spark.createDataFrame(data, "seq long, title string, content string, ts string") \
        .select("seq", "title", "content", F.to_timestamp("ts").alias("ingested_at")) \
        .coalesce(1).write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    out = str(tmp_path / "out")
    q = (st.dedupe_within_watermark(st.file_stream(spark, str(src), schema))
         .writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 2 and got.select("content_hash").distinct().count() == 2


def _raw_file(spark, folder, name, records):
    """One parquet file of (seq, content, day or None) in a stream's folder."""
    df = spark.createDataFrame([(s, f"t{s}", c, "src", d) for s, c, d in records],
                               "seq long, title string, content string, source string, day string")
    df = df.select("seq", "title", "content", "source", F.to_timestamp("day").alias("ingested_at"))
    folder.mkdir(exist_ok=True)
    df.toPandas().astype({"ingested_at": "datetime64[us]"}).to_parquet(str(folder / name), index=False)
    return df.schema


def test_stream_ingest_keeps_rows_of_other_feeds_and_checkpoints(spark, tmp_path):
    from articlespark.streaming import ingest as st

    one, two, store = tmp_path / "one", tmp_path / "two", str(tmp_path / "store")
    d = "2024-01-0%d"
    schema = _raw_file(spark, one, "a.parquet", [(1, "alpha", d % 1), (2, "beta", d % 1)])
    _raw_file(spark, one, "b.parquet", [(3, "alpha", d % 2), (4, "gamma", d % 2)])
    _raw_file(spark, one, "c.parquet", [(5, "gamma", d % 3), (6, None, None)])

    def run(folder, checkpoint):
        stream = st.file_stream(spark, str(folder), schema, max_files=1)
        st.stream_exact_ingest(stream, store, str(tmp_path / checkpoint))
        return rows(spark.read.parquet(store), "seq")

    whole = [(1,), (2,), (4,), (6,)]
    assert run(one, "k1") == whole  # three micro-batches
    assert spark.read.parquet(store).select("batch_id").distinct().count() >= 2
    assert run(one, "k1") == whole  # nothing new
    _raw_file(spark, two, "a.parquet", [(10, "delta", d % 3), (11, "alpha", d % 3)])
    assert run(two, "k2") == [*whole, (10,)]  # another feed's batch 0
    assert run(one, "k3") == [*whole, (10,)]  # the first feed again, its checkpoint lost


def test_stream_daily_counts_late_rows(spark, tmp_path):
    from articlespark.streaming import ingest as st

    src, out = tmp_path / "raw", str(tmp_path / "out")
    src.mkdir()
    days = {"a.parquet": ["2024-03-20", "2024-03-20"], "b.parquet": ["2024-03-02", None, "2024-03-20"]}
    for name, ts in days.items():
        df = spark.createDataFrame([(t, 0.5) for t in ts], "t string, score double") \
            .select(F.to_timestamp("t").alias("ts"), "score")
        df.toPandas().astype({"ts": "datetime64[us]"}).to_parquet(str(src / name), index=False)
    for _ in range(2):  # the second run finds nothing new
        st.stream_daily_sentiment(st.file_stream(spark, str(src), df.schema, max_files=1), out, str(tmp_path / "k"))
        got = rows(st.latest_windows(spark, out).selectExpr("string(day) AS day", "avg_score", "pos", "total"))
        assert got == [("2024-03-02", 0.5, 1, 1), ("2024-03-20", 0.5, 3, 3)]
