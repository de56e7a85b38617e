"""Registered cleaning, feed and store queries (F1-F4, F6, F8, F9, F12, P5-P9,
J7, J9, T1, T3, A15, D1, D4, D6, D10, D12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sentiment import policy_label
from ..functions.text import clean_text, content_hash, first_line
from ..operators import dedupe, feed
from ..operators.store import fold_alt_sources, purge, upsert, upsert_rejects, write_back_scores
from ..session import spread
from ..sources.tables import articles_view, events_view, raw_batch_view, read_table
from .analytics import store_tables
from .registry import (ARTICLES_CTE, EVENTS_CTE, FOLD_SQL, SOURCES_CTE, clean_sql, hash_sql, norm_sql,
                       register, ts_text)

SEARCH = "ingen|thorre"
NOW = "2024-02-20 12:00:00"


@register("search_feed", "P7,D10,S10", f"""
WITH {ARTICLES_CTE.strip()}
SELECT id, title, source FROM articles
WHERE coalesce(regexp_matches(title, '{SEARCH}', 'i'), false)
   OR coalesce(regexp_matches(content, '{SEARCH}', 'i'), false)
   OR coalesce(regexp_matches(source, '{SEARCH}', 'i'), false)""")
def q_search_feed(spark, sf_dir):
    return feed.search_filter(articles_view(spark, sf_dir), SEARCH).select("id", "title", "source")


@register("bucket_filter", "P6,P5", f"""
WITH {ARTICLES_CTE.strip()}
SELECT id, source, sentiment_score FROM articles
WHERE source = 'src3' AND sentiment_score >= -0.1 AND sentiment_score <= 0.1""")
def q_bucket_filter(spark, sf_dir):
    df = feed.bucket_filter(feed.source_filter(articles_view(spark, sf_dir), "src3"), "Neutral")
    return df.select("id", "source", "sentiment_score")


def source_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, lang``: each source's majority language (ties: smaller code)."""
    docs = read_table(spark, sf_dir, "documents")
    c = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("source").agg(
        F.min_by("lang", F.struct((-F.col("n")).alias("k"), F.col("lang"))).alias("lang"))


@register("language_filter", "P8,J9", f"""
WITH {ARTICLES_CTE.strip()},
c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang),
sl AS (SELECT source, lang FROM c
       QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1)
SELECT id, source FROM articles
WHERE source IN (SELECT source FROM sl WHERE lang = 'en')""")
def q_language_filter(spark, sf_dir):
    arts = articles_view(spark, sf_dir)
    return feed.language_filter(arts, "en", source_language(spark, sf_dir)).select("id", "source")


@register("date_range", "P9,F14", f"""
WITH {ARTICLES_CTE.strip()}
SELECT id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date FROM articles
WHERE CAST(date AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""")
def q_date_range(spark, sf_dir):
    df = feed.date_range(articles_view(spark, sf_dir), "2024-01-10", "2024-01-20")
    return df.select("id", ts_text("date").alias("date"))


@register("feed_page", "D10,T1,T3,F8,F6,F9,P12", f"""
WITH {ARTICLES_CTE.strip()}
SELECT source, title,
       CASE WHEN length(content) > 120 THEN substr(content, 1, 120) || '…' ELSE content END AS snippet,
       category,
       CASE WHEN sentiment_score > 0.1 THEN 'positive' WHEN sentiment_score < -0.1 THEN 'negative'
            ELSE 'neutral' END AS sentiment,
       sentiment_score,
       strftime(coalesce(date, TIMESTAMP '{NOW}'), '%Y-%m-%d %H:%M') AS timestamp
FROM articles
WHERE (coalesce(regexp_matches(title, '{SEARCH}', 'i'), false)
       OR coalesce(regexp_matches(content, '{SEARCH}', 'i'), false)
       OR coalesce(regexp_matches(source, '{SEARCH}', 'i'), false))
  AND sentiment_score > 0.1
ORDER BY id DESC LIMIT 50""")
def q_feed_page(spark, sf_dir):
    return feed.feed_page(articles_view(spark, sf_dir), NOW, 50, search=SEARCH, bucket="Positive")


@register("feed_counters", "A15,G3", f"""
WITH {ARTICLES_CTE.strip()},
f AS (SELECT * FROM articles
      WHERE (coalesce(regexp_matches(title, '{SEARCH}', 'i'), false)
             OR coalesce(regexp_matches(content, '{SEARCH}', 'i'), false)
             OR coalesce(regexp_matches(source, '{SEARCH}', 'i'), false))
        AND sentiment_score > 0.1)
SELECT least(count(*), 50) AS showing, count(*) AS total FROM f""")
def q_feed_counters(spark, sf_dir):
    return feed.feed_counters(articles_view(spark, sf_dir), 50, search=SEARCH, bucket="Positive")


@register("normalize_fingerprint", "F2,F3,F4", f"""
SELECT doc_id, {norm_sql('split_part(text, chr(10), 1)')} AS norm_title,
       {hash_sql('text')} AS content_hash
FROM documents""")
def q_normalize_fingerprint(spark, sf_dir):
    from ..functions.text import normalize_text

    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", normalize_text(first_line("text")).alias("norm_title"),
                       content_hash("text").alias("content_hash"))


@register("clean_text", "F1,F20", f"""
SELECT doc_id, {clean_sql('text')} AS clean FROM documents""")
def q_clean_text(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", clean_text("text").alias("clean"))


@register("label_policies", "F6", f"""
WITH {EVENTS_CTE.strip()}
SELECT event_id,
       CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END
         AS label_classify,
       CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative'
            WHEN score >= -0.1 AND score <= 0.1 THEN 'neutral' END AS label_bucket,
       CASE WHEN coalesce(score, 0.0) > 0.2 THEN 'positive'
            WHEN coalesce(score, 0.0) < -0.2 THEN 'negative' ELSE 'neutral' END AS label_cards
FROM ev""")
def q_label_policies(spark, sf_dir):
    ev = events_view(spark, sf_dir)
    return ev.select("event_id", policy_label("score", "classify").alias("label_classify"),
                     policy_label("score", "bucket").alias("label_bucket"),
                     policy_label("score", "cards").alias("label_cards"))


def _dedupe_input(spark, sf_dir, title):
    raw = raw_batch_view(spark, sf_dir, title=title).drop("url")  # documents carry no url
    return dedupe.with_content_hash(spread(raw))


_D1_SQL = """
WITH b AS (SELECT doc_id AS seq, {title} AS title, source, {hash} AS content_hash FROM documents),
p1 AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY {norm} ORDER BY seq) = 1),
p2 AS (SELECT * FROM p1 QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY seq) = 1)
SELECT seq, title, source, content_hash FROM p2"""


@register("exact_dedupe", "D1,W1,F2,F3,F4,S5,G4", _D1_SQL.format(
    title="split_part(text, chr(10), 1)", hash=hash_sql("text"), norm=norm_sql("title")))
def q_exact_dedupe(spark, sf_dir):
    out = dedupe.exact_deduplicate(_dedupe_input(spark, sf_dir, "first_line"))
    return out.select("seq", "title", "source", "content_hash")


@register("exact_dedupe_hash", "D1,W1", _D1_SQL.format(
    title="source || ' ' || CAST(doc_id AS VARCHAR)", hash=hash_sql("text"), norm=norm_sql("title")))
def q_exact_dedupe_hash(spark, sf_dir):
    out = dedupe.exact_deduplicate(_dedupe_input(spark, sf_dir, "unique"))
    return out.select("seq", "title", "source", "content_hash")


@register("analysis_clean", "D6,P2,P3,F7", f"""
WITH {ARTICLES_CTE.strip()}
SELECT id, title, source, coalesce(category, 'Unknown') AS category FROM articles
WHERE title IS NOT NULL AND content IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY title, source ORDER BY id) = 1""")
def q_analysis_clean(spark, sf_dir):
    return dedupe.analysis_clean(articles_view(spark, sf_dir)).select("id", "title", "source", "category")


def _split_store_batch(spark, sf_dir):
    """Store = articles dated before the midpoint of the time range (deduped
    on content_hash, alt_sources ''), batch = the later ones, each recording
    its own source in alt_sources.  Urls (a fifth has none) repeat within a source
    after seven tenths of the ids, so some of the batch's are taken."""
    t = store_tables(spark, sf_dir)
    period = articles_view(spark, sf_dir).select(F.expr("max(id) * 7 div 10 + 1")).scalar()
    arts = (spread(articles_view(spark, sf_dir))
            .join(t["sources"].select(F.col("name").alias("source"), F.col("id").alias("source_id")), "source")
            .withColumn("content_hash", content_hash("content"))
            .withColumn("url", F.when(F.col("id") % 5 != 0, F.concat(
                F.lit("https://"), "source", F.lit(".example/"), (F.col("id") % period).cast("string"))))
            .checkpoint())  # hashed once; store and batch branches all read it
    secs = F.unix_seconds("date")
    mid2 = arts.select(F.min(secs) + F.max(secs)).scalar()
    store = dedupe.keep_first(arts.where(secs * 2 < mid2).withColumn("alt_sources", F.lit("")),
                              ["content_hash"], "id").checkpoint()  # as a stored table: the upsert reads it several times
    batch = (arts.where(secs * 2 >= mid2).withColumn("seq", F.col("id"))
             .withColumn("alt_sources", F.col("source")))
    return store.drop("source"), batch.drop("source")


_UPSERT_CTE = f"""
WITH {ARTICLES_CTE.strip()}, {SOURCES_CTE.strip()},
h AS (SELECT *, {hash_sql('content')} AS content_hash,
             CASE WHEN id % 5 <> 0 THEN 'https://' || source || '.example/' || (id % p.period) END AS url,
             date_diff('second', TIMESTAMP '1970-01-01', date) AS secs
      FROM articles, (SELECT max(id) * 7 // 10 + 1 AS period FROM articles) p WHERE source IS NOT NULL),
b AS (SELECT min(secs) + max(secs) AS mid2 FROM h),
store AS (SELECT id, title, url, content_hash, source, '' AS alt_sources FROM h, b WHERE h.secs * 2 < b.mid2
          QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY id) = 1),
batch AS (SELECT id AS seq, title, url, content_hash, source, source AS alt_sources FROM h, b
          WHERE h.secs * 2 >= b.mid2),
new AS (SELECT * FROM batch WHERE content_hash NOT IN (SELECT content_hash FROM store)),
taken AS (SELECT url FROM store WHERE url IS NOT NULL),
claims AS (SELECT url, arg_min(content_hash, seq) AS owner FROM new
           WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM taken) GROUP BY url),
refused AS (SELECT seq FROM new WHERE url IN (SELECT url FROM taken)
            UNION SELECT n.seq FROM new n JOIN claims c ON n.url = c.url WHERE n.content_hash <> c.owner)"""


@register("upsert_rejects", "D4", f"""{_UPSERT_CTE}
SELECT seq, url, content_hash FROM batch WHERE seq IN (SELECT seq FROM refused)""")
def q_upsert_rejects(spark, sf_dir):
    store, batch = _split_store_batch(spark, sf_dir)
    return upsert_rejects(store, batch, order="seq").select("seq", "url", "content_hash")


@register("upsert_articles", "D4,F12", f"""{_UPSERT_CTE},
adds AS (SELECT content_hash, alt_sources AS a, min(seq) AS first FROM batch
         WHERE alt_sources IS NOT NULL AND alt_sources <> '' AND seq NOT IN (SELECT seq FROM refused)
         GROUP BY content_hash, alt_sources),
addl AS (SELECT content_hash, list(a ORDER BY first) AS adds FROM adds GROUP BY content_hash),
existing AS (SELECT s.id, s.title, s.url, s.content_hash, s.source,
                    CASE WHEN l.adds IS NULL THEN s.alt_sources
                         ELSE list_reduce(list_prepend(coalesce(s.alt_sources, ''), l.adds), {FOLD_SQL}) END
                      AS alt_sources
             FROM store s LEFT JOIN addl l ON s.content_hash = l.content_hash),
fresh0 AS (SELECT * FROM new WHERE seq NOT IN (SELECT seq FROM refused)
           QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY seq) = 1),
fresh AS (SELECT (SELECT coalesce(max(id), 0) FROM store) + row_number() OVER (ORDER BY f.seq) AS id,
                 f.title, f.url, f.content_hash, f.source,
                 CASE WHEN l.adds IS NULL THEN coalesce(f.alt_sources, '')
                      ELSE list_reduce(list_prepend('', l.adds), {FOLD_SQL}) END AS alt_sources
          FROM fresh0 f LEFT JOIN addl l ON f.content_hash = l.content_hash),
u AS (SELECT * FROM existing UNION ALL SELECT * FROM fresh)
SELECT u.id, u.title, u.url, u.content_hash, s.id AS source_id, u.alt_sources
FROM u JOIN sources s ON s.name = u.source""")
def q_upsert_articles(spark, sf_dir):
    store, batch = _split_store_batch(spark, sf_dir)
    out = upsert(store, batch, order="seq")
    return out.select("id", "title", "url", "content_hash", "source_id", "alt_sources")


@register("score_writeback", "J7,D7", f"""
WITH {ARTICLES_CTE.strip()}
SELECT a.id, coalesce((l.quality - l.toxic) * 1.0::DOUBLE, a.sentiment_score) AS sentiment_score
FROM articles a LEFT JOIN labels l ON a.id = l.doc_id""")
def q_score_writeback(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels")
    scores = labels.select(F.col("doc_id").alias("id"),
                           ((F.col("quality") - F.col("toxic")) * 1.0).cast("double").alias("score"))
    return write_back_scores(articles_view(spark, sf_dir), scores).select("id", "sentiment_score")


@register("purge_articles", "D12", f"""
WITH {ARTICLES_CTE.strip()}
SELECT id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date FROM articles
WHERE date IS NULL OR CAST(date AS DATE) >= DATE '{NOW[:10]}' - INTERVAL 30 DAY""")
def q_purge_articles(spark, sf_dir):
    kept, _ = purge(articles_view(spark, sf_dir), NOW, days=30)
    return kept.select("id", ts_text("date").alias("date"))


@register("alt_sources_fold", "F12,J8", f"""
WITH {ARTICLES_CTE.strip()},
h AS (SELECT id, source, {hash_sql('content')} AS content_hash FROM articles),
f AS (SELECT content_hash, source, min(id) AS first FROM h GROUP BY content_hash, source),
l AS (SELECT content_hash, list_reduce(list_prepend('', list(source ORDER BY first)), {FOLD_SQL})
             AS alt_sources FROM f GROUP BY content_hash),
c AS (SELECT content_hash, count(*) AS copies FROM h GROUP BY content_hash)
SELECT c.content_hash, c.copies, l.alt_sources FROM c JOIN l ON c.content_hash = l.content_hash""")
def q_alt_sources_fold(spark, sf_dir):
    h = spread(articles_view(spark, sf_dir).select("id", "source", "content")).withColumn("content_hash", content_hash("content"))
    return fold_alt_sources(h, "content_hash", "source", "id")



@register("recent_window", "P4,P10", f"""
WITH {ARTICLES_CTE.strip()}
SELECT id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date FROM articles
WHERE date >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 72 HOUR""")
def q_recent_window(spark, sf_dir):
    """The 72-hour look-back of the dedupe and merge jobs, ``now`` fixed."""
    df = feed.recent(articles_view(spark, sf_dir), "2024-01-20 12:00:00", hours=72)
    return df.select("id", ts_text("date").alias("date"))


@register("search_literal", "P7b", f"""
WITH {ARTICLES_CTE.strip()}
SELECT id, title, source FROM articles
WHERE coalesce(instr(lower(title), 'the') > 0, false) OR coalesce(instr(lower(source), 'the') > 0, false)""")
def q_search_literal(spark, sf_dir):
    df = feed.search_filter(articles_view(spark, sf_dir), "the", columns=("title", "source"), literal=True)
    return df.select("id", "title", "source")


@register("feed_cards", "F19,F6,A15", f"""
WITH {ARTICLES_CTE.strip()}
SELECT id, title, source, coalesce(nullif(category, ''), 'NEWS') AS category,
       coalesce(sentiment_score, 0.0) AS score,
       CASE WHEN coalesce(sentiment_score, 0.0) > 0.2 THEN 'positive'
            WHEN coalesce(sentiment_score, 0.0) < -0.2 THEN 'negative' ELSE 'neutral' END AS label
FROM articles""")
def q_feed_cards(spark, sf_dir):
    return feed.card_fields(articles_view(spark, sf_dir))


@register("hero_counters", "A15", f"""
WITH {ARTICLES_CTE.strip()}
SELECT count(*) AS articles, count(DISTINCT source) AS sources FROM articles""")
def q_hero_counters(spark, sf_dir):
    return feed.hero_counters(articles_view(spark, sf_dir))
