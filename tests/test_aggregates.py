import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from articlespark.operators import aggregates as agg
from articlespark.operators import feed
from articlespark.operators.quantiles import exact_quantiles
from frames import rows

ART_SCHEMA = "id long, title string, content string, source string, date timestamp, category string, " \
             "sentiment_score double"


@pytest.fixture
def store3(spark):
    arts = spark.createDataFrame([
        (1, "Bridge Reopens", "Traffic flows again", "BBC", datetime(2025, 6, 1, 10), "tech", 0.5),
        (2, "Mill Closes", "Workers sent home", "VnExpress", datetime(2025, 6, 2, 11), "finance", -0.6),
        (3, "Council Meets", "No vote taken", "BBC", datetime(2025, 6, 3, 9), "world", 0.0),
    ], ART_SCHEMA)
    sources = spark.createDataFrame([(1, "BBC"), (2, "VnExpress")], "id long, name string")
    return arts, sources


def test_store_stats(spark, store3):
    arts, sources = store3
    kw = spark.createDataFrame([], "id long, keyword string")
    r = agg.store_stats(arts, sources, kw).first().asDict()
    assert r == {"total_articles": 3, "total_sources": 2, "total_keywords": 0, "avg_sentiment": -0.0333,
                 "pos_count": 1, "neg_count": 1, "neut_count": 1}
    empty = agg.store_stats(arts.limit(0), sources.limit(0), kw).first().asDict()
    assert empty["total_articles"] == 0 and empty["avg_sentiment"] == 0.0


def test_sentiment_index(spark, store3):
    arts, sources = store3
    kw = spark.createDataFrame([], "id long, keyword string")
    r = agg.sentiment_index(agg.store_stats(arts, sources, kw)).first()
    assert (r.pos_pct, r.neg_pct, r.neu_pct) == (33.3, 33.3, 33.4)


@pytest.mark.parametrize("n,scores,expect", [
    (99, [0.13636363636363635] * 3, (0.0041, 3, 96, 0)),
    (143, [0.13636363636363635] * 4, (0.0038, 4, 139, 0)),
    (44, [0.4166666666666667, 0.13636363636363635], (0.0126, 2, 42, 0)),
])
def test_report_summary_goldens(spark, n, scores, expect):
    data = [(i, "t", "VnExpress", scores[i] if i < len(scores) else 0.0) for i in range(n)]
    df = spark.createDataFrame(data, "id long, title string, source string, sentiment_score double")
    r = agg.report_summary(df, "2026-06-11").first()
    assert r.total_articles == n and r.sources_analyzed == 1
    b = r.sentiment_breakdown
    assert (r.average_sentiment, b.positive, b.neutral, b.negative) == expect


def test_report_summary_empty(spark):
    df = spark.createDataFrame([], "id long, source string, sentiment_score double")
    assert agg.report_summary(df, "2026-06-11").count() == 0


def test_boxplot_stats_small(spark):
    df = spark.createDataFrame([("s", float(v)) for v in (1, 2, 3, 10)], "source string, sentiment_score double")
    r = agg.boxplot_stats(df).first()
    assert (r.q1, r.median, r.q3) == (1.75, 2.5, 4.75)
    assert (r.lower_fence, r.upper_fence) == (-2.75, 9.25)
    assert (r.whisker_low, r.whisker_high, r.n_outliers) == (1.0, 3.0, 1)


def test_exact_quantiles_match_numpy_with_hot_group(spark):
    import numpy as np

    rnd = random.Random(7)
    data = [("hot", float(rnd.randint(0, 500))) for _ in range(3000)]
    data += [(f"g{i % 5}", float(rnd.random())) for i in range(400)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: (r.n, r.q1, r.q2, r.q3) for r in exact_quantiles(df, "g", "v", [0.1, 0.5, 0.9],
                                                                     ["q1", "q2", "q3"]).collect()}
    for g in {d[0] for d in data}:
        vals = np.array([v for k, v in data if k == g])
        exp = np.quantile(vals, [0.1, 0.5, 0.9])
        assert got[g][0] == len(vals)
        assert np.allclose(got[g][1:], exp, rtol=0, atol=1e-12)


def test_daily_and_source_aggregates(spark, store3):
    arts, _ = store3
    assert rows(agg.source_comparison(arts)) == [("BBC", 2, 0.25), ("VnExpress", 1, -0.6)]
    d = agg.daily_sentiment_ratio(arts).orderBy("day").collect()
    assert [(str(r.day), r.pos, r.neg, r.total) for r in d] == [
        ("2025-06-01", 1, 0, 1), ("2025-06-02", 0, 1, 1), ("2025-06-03", 0, 0, 1)]
    share = agg.category_share(arts).collect()
    assert [(r.category, r.article_count, r.share_pct) for r in share] == [
        ("finance", 1, 33.3), ("tech", 1, 33.3), ("world", 1, 33.3)]


def test_pivot_keeps_source_columns(spark, store3):
    arts, _ = store3
    p = agg.category_source_pivot(arts, ["BBC", "VnExpress"]).orderBy("category").collect()
    assert [tuple(r) for r in p] == [("finance", None, -0.6), ("tech", 0.5, None), ("world", 0.0, None)]


def test_feed_filters(spark, store3):
    arts, _ = store3
    arts = arts.withColumn("date", F.to_timestamp(F.to_date("date")))
    assert rows(feed.search_filter(arts, "bridge", columns=("title", "source"), literal=True), "id") == [(1,)]
    assert rows(feed.search_filter(arts, "vnexpress"), "id") == [(2,)]
    assert rows(feed.date_range(arts, "2025-06-01", "2025-06-02"), "id") == [(1,), (2,)]
    assert rows(feed.bucket_filter(arts, "Positive"), "id") == [(1,)]
    assert rows(feed.bucket_filter(arts, "Negative"), "id") == [(2,)]
    assert feed.search_filter(arts, "").count() == 3
    assert rows(feed.language_filter(arts, "Vietnamese"), "id") == [(2,)]
    assert feed.language_filter(arts, "English").count() == 2


def test_feed_page_and_counters(spark, store3):
    arts, _ = store3
    page = feed.feed_page(arts, "2025-06-10 00:00:00", limit=2).collect()
    assert [r.title for r in page] == ["Council Meets", "Mill Closes"]
    assert page[1].sentiment == "negative" and page[0].timestamp == "2025-06-03 09:00"
    c = feed.feed_counters(arts, limit=2).first()
    assert (c.showing, c.total) == (2, 3)


def test_title_word_counts_tie_order(spark):
    df = spark.createDataFrame([(2, "Gamma Beta"), (1, "Alpha Beta")], "id long, title string")
    got = [tuple(r) for r in agg.title_word_counts(df).collect()]
    # newest article (id 2) is read first: Gamma before Alpha on ties
    assert got == [("Beta", 2), ("Gamma", 1), ("Alpha", 1)]


def test_sort_as_text_and_bundle(spark, store3):
    df = spark.createDataFrame([("BBC",), (None,), ("123",), ("VnExpress",), ("45.6",)], "v string")
    assert [r.v for r in feed.sort_as_text(df, "v").collect()] == [None, "123", "45.6", "BBC", "VnExpress"]
    arts, sources = store3
    kw = spark.createDataFrame([], "id long, keyword string")
    ak = spark.createDataFrame([], "article_id long, keyword_id long")
    b = agg.dashboard_bundle(arts, sources, kw, ak)
    assert set(b) == {"stats", "timeline", "sources", "categories", "keywords"}
    assert b["stats"].first().total_articles == 3 and b["keywords"].count() > 0
