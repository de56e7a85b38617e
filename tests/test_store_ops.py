from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from articlespark.operators import dedupe
from articlespark.operators.ids import dense_ids
from articlespark.operators.store import (fold_alt_sources, get_or_create_sources, purge, upsert, upsert_rejects,
                                          write_back_scores)
from articlespark.sources.tables import ARTICLES_SCHEMA
from frames import rows


def test_exact_dedupe_by_url_title_and_content(spark):
    df = spark.createDataFrame(
        [(1, "Tides", "http://x.org/1", "calm sea"), (2, "tides ", "http://x.org/2", "storm"),
         (3, "Nets", "http://x.org/1", "haul"), (4, "Oars", "http://x.org/4", "Calm  sea")],
        "seq long, title string, url string, content string")
    out = dedupe.exact_deduplicate(dedupe.with_content_hash(df))
    assert rows(out, "seq", "title") == [(1, "Tides")]


def test_exact_dedupe_passes_are_sequential(spark):
    df = spark.createDataFrame([(1, "A", "u1"), (2, "B", "u1"), (3, "B", "u2")],
                               "seq long, title string, url string")
    assert rows(dedupe.exact_deduplicate(df), "seq") == [(1,), (3,)]


def test_null_keys_policy(spark):
    df = spark.createDataFrame([(1, "A", None), (2, "B", None)], "seq long, title string, url string")
    assert len(rows(dedupe.exact_deduplicate(df))) == 1
    assert len(rows(dedupe.exact_deduplicate(df, null_keys="distinct"))) == 2


def _batch(spark, data):
    cols = [f.name for f in ARTICLES_SCHEMA.fields]
    full = [(None, t, None, c, h, 1, alt, None, None, 0.0, seq) for seq, t, c, h, alt in data]
    schema = T.StructType(list(ARTICLES_SCHEMA.fields) + [T.StructField("seq", T.LongType())])
    return spark.createDataFrame(full, schema).select(*cols, "seq")


def test_upsert_alt_sources(spark):
    empty = spark.createDataFrame([], ARTICLES_SCHEMA)
    s1 = upsert(empty, _batch(spark, [(1, "first", "body", "h1", ""), (2, "second", "body", "h1", "BBC")]))
    assert rows(s1, "id", "title", "alt_sources") == [(1, "first", "BBC")]
    s2 = upsert(s1, _batch(spark, [(3, "again", "body", "h1", "BBC")]))
    assert rows(s2, "title", "alt_sources") == [("first", "BBC")]
    s3 = upsert(s2, _batch(spark, [(4, "again", "body", "h1", "CNN"), (5, "new", "b2", "h2", "")]))
    assert rows(s3, "id", "title", "alt_sources") == [(1, "first", "BBC,CNN"), (2, "new", "")]


def test_source_dimension_and_writeback(spark):
    batch = spark.createDataFrame([(1, "BBC", "u1"), (2, "CNN", "u2"), (3, "BBC", "u3")],
                                  "seq long, source string, source_url string")
    dim = get_or_create_sources(batch)
    assert rows(dim) == [(1, "BBC", "u1"), (2, "CNN", "u2")]
    more = spark.createDataFrame([(4, "AP", "u4"), (5, "BBC", "x")], "seq long, source string, source_url string")
    assert rows(get_or_create_sources(more, dim)) == [(1, "BBC", "u1"), (2, "CNN", "u2"), (3, "AP", "u4")]
    arts = spark.createDataFrame([(1, 0.5), (2, 0.1)], "id long, sentiment_score double")
    scores = spark.createDataFrame([(2, -0.4)], "id long, score double")
    assert rows(write_back_scores(arts, scores)) == [(1, 0.5), (2, -0.4)]


def test_purge_calendar_day_and_nulls(spark):
    now = "2024-02-20 12:00:00"
    df = spark.createDataFrame(
        [(1, datetime(2024, 1, 20, 23, 0)), (2, datetime(2024, 1, 21, 0, 0)), (3, None)],
        "id long, date timestamp")
    kept, deleted = purge(df, now, days=30)
    assert rows(deleted, "id") == [(1,)]
    assert rows(kept, "id") == [(2,), (3,)]


def test_fold_alt_sources_first_appearance(spark):
    df = spark.createDataFrame([(1, "h", "BBC"), (2, "h", "CNN"), (3, "h", "BBC"), (4, "g", "AP")],
                               "id long, content_hash string, source string")
    assert rows(fold_alt_sources(df)) == [("g", 1, "AP"), ("h", 3, "BBC,CNN")]


def test_dense_ids_are_dense_and_ordered(spark):
    df = spark.range(0, 997).select((F.col("id") * 7 % 997).alias("k"))
    out = dense_ids(df, ["k"], start=10, partitions=5)
    got = rows(out, "k", "id")
    assert got == [(k, k + 10) for k in range(997)]


def test_ingest_batch_end_to_end(spark):
    from articlespark.functions.sentiment import lexicon_frame
    from articlespark.operators.ingest import ingest_batch, rescore
    from articlespark.operators.store import empty_store

    now = datetime(2025, 6, 10, 12)
    raw_schema = ("seq long, title string, url string, content string, category string, date timestamp, "
                  "source string, source_url string")
    st = empty_store(spark)
    b1 = spark.createDataFrame([
        (1, "Garden Lantern 1", "u1", "It was the garden lantern.", "News", now, "VnExpress", "https://vnexpress.net"),
        (2, "Other story", "u2", "Completely different words here.", "News", now, "VnExpress", "https://vnexpress.net"),
        (3, "Other story", "u3", "Copy by title.", "News", now, "BBC", "https://www.bbc.com"),
    ], raw_schema)
    arts, srcs, _ = ingest_batch(b1, st["articles"], st["sources"], now, threshold=0.6)
    arts, srcs = arts.checkpoint(), srcs.checkpoint()
    assert rows(arts, "id", "title", "alt_sources") == [(1, "Garden Lantern 1", ""), (2, "Other story", "")]
    b2 = spark.createDataFrame([
        (10, "Garden Lantern 1 Repair", "u9", "It was the garden lantern with crooked handles.", "World", now, "BBC",
         "https://www.bbc.com"),
        (11, "Fresh", "u10", "Brand new unrelated text.", "World", now, "BBC", "https://www.bbc.com"),
    ], raw_schema)
    arts2, srcs2, matches = ingest_batch(b2, arts, srcs, now, threshold=0.6)
    assert rows(matches, "seq", "store_id") == [(10, 1)]
    assert rows(arts2, "id", "title", "alt_sources") == [(1, "Garden Lantern 1", "BBC"), (2, "Other story", ""),
                                                         (3, "Fresh", "")]
    assert rows(srcs2, "id", "name") == [(1, "VnExpress"), (2, "BBC")]
    scored = dict(rows(rescore(arts2.withColumn("content", F.lit("good news")), lexicon_frame(spark)),
                       "id", "sentiment_score"))
    assert scored == {1: 0.7, 2: 0.7, 3: 0.7}


def test_missing_store_reads_empty(spark, tmp_path):
    from articlespark.operators.aggregates import store_stats, table_sizes
    from articlespark.sources.tables import ARTICLES_SCHEMA, SOURCES_SCHEMA, read_or_empty

    arts = read_or_empty(spark, str(tmp_path / "missing_articles"), ARTICLES_SCHEMA)
    srcs = read_or_empty(spark, str(tmp_path / "missing_sources"), SOURCES_SCHEMA)
    assert arts.count() == 0 and arts.schema == ARTICLES_SCHEMA
    sizes = dict(rows(table_sizes({"Articles": arts, "Sources": srcs})))
    assert sizes == {"Articles": 0, "Sources": 0}
    kw = spark.createDataFrame([], "id long, keyword string")
    s = store_stats(arts, srcs, kw).first()
    assert (s.total_articles, s.avg_sentiment, s.neut_count) == (0, 0.0, 0)


def test_analysis_clean_parses_dates_leniently(spark):
    df = spark.createDataFrame(
        [(1, "A", "x", "BBC", "2025-06-01 10:00:00", None), (2, "A", "y", "BBC", "2025-06-02", "tech"),
         (3, "B", None, "BBC", "not a date", "tech"), (4, "C", "z", "CNN", "garbage", "world")],
        "id long, title string, content string, source string, date string, category string")
    out = dedupe.analysis_clean(df).orderBy("id").collect()
    assert [(r.id, r.category, r.date is None) for r in out] == [(1, "Unknown", False), (4, "world", True)]


def test_prune_bridge(spark):
    from articlespark.operators.store import prune_bridge

    bridge = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "article_id long, keyword_id long")
    kept = spark.createDataFrame([(1,), (3,)], "id long")
    assert rows(prune_bridge(bridge, kept)) == [(1, 10), (3, 11)]


def _sequential_d1(recs):
    """Plain-Python sequential passes: url, normalised title, content."""
    import re

    def norm(t):
        return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", t or "")).strip().lower()

    out = sorted(recs)
    for key in (lambda r: r[2], lambda r: norm(r[1]), lambda r: norm(r[3])):
        seen, kept = set(), []
        for r in out:
            k = key(r)
            if k not in seen:
                seen.add(k)
                kept.append(r)
        out = kept
    return [r[0] for r in out]


def test_exact_dedupe_matches_sequential_passes(spark):
    import random

    rnd = random.Random(17)
    titles, urls, bodies = ["A", "a ", "B", "<b>B</b>", "C"], ["u1", "u2", "u3", None], ["x", "X ", "y", "z"]
    for _ in range(5):
        recs = [(i, rnd.choice(titles), rnd.choice(urls), rnd.choice(bodies)) for i in range(rnd.randint(3, 14))]
        df = spark.createDataFrame(recs, "seq long, title string, url string, content string")
        got = [r[0] for r in rows(dedupe.exact_deduplicate(dedupe.with_content_hash(df)), "seq")]
        assert got == _sequential_d1(recs), recs


def test_upsert_is_idempotent(spark):
    empty = spark.createDataFrame([], ARTICLES_SCHEMA)
    batch = _batch(spark, [(1, "t1", "b1", "h1", "BBC"), (2, "t2", "b1", "h1", "CNN"), (3, "t3", "b3", "h3", "")])
    once = upsert(empty, batch).checkpoint()
    twice = upsert(once, batch)
    assert rows(twice) == rows(once)


def _with_urls(spark, data):
    df = _batch(spark, [(seq, f"t{seq}", "body", h, alt) for seq, h, _, alt in data])
    urls = spark.createDataFrame([(seq, u) for seq, _, u, _ in data], "seq long, _u string")
    return df.join(urls, "seq").withColumn("url", F.col("_u")).select(*[f.name for f in ARTICLES_SCHEMA.fields], "seq")


def test_upsert_urls_are_unique_first_wins(spark):
    empty = spark.createDataFrame([], ARTICLES_SCHEMA)
    first = _with_urls(spark, [(1, "h1", "u1", "A"), (2, "h2", "u1", "B"), (3, "h3", None, ""), (4, "h4", None, ""),
                               (5, "h5", "", ""), (6, "h6", "", ""), (7, "h1", "u1", "C")])
    assert rows(upsert_rejects(empty, first), "seq") == [(2,)]
    store = upsert(empty, first).checkpoint()
    assert rows(store, "id", "content_hash", "alt_sources") == [
        (1, "h1", "A,C"), (2, "h3", ""), (3, "h4", ""), (4, "h5", ""), (5, "h6", "")]
    # a stored url refuses other contents; a stored hash merges whatever its url; the refused row adds nothing
    again = _with_urls(spark, [(8, "h9", "u1", "D"), (9, "h1", "u7", "E"), (10, "h8", "u7", "")])
    assert rows(upsert_rejects(store, again), "seq") == [(8,)]
    out = upsert(store, again)
    assert rows(out.where("id = 1"), "url", "alt_sources") == [("u1", "A,C,E")]
    assert rows(out.where("id > 5"), "id", "content_hash", "url") == [(6, "h8", "u7")]


def test_upsert_keeps_null_hashes_apart(spark):
    empty = spark.createDataFrame([], ARTICLES_SCHEMA)
    batch = _with_urls(spark, [(1, None, None, ""), (2, None, None, ""), (3, None, "u1", ""), (4, None, "u1", ""),
                               (5, "h", "u1", "")])
    assert rows(upsert(empty, batch), "id", "title") == [(1, "t1"), (2, "t2"), (3, "t3")]
    assert rows(upsert_rejects(empty, batch), "seq") == [(4,), (5,)]
    assert rows(upsert(empty, batch.limit(0))) == []
