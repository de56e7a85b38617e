"""Registered queries of sources and sinks: raw batches, exports read back, defaults,
lenient dates, capped vocabularies, text order, the dashboard's data (S2, S5, S9-S11, F7, F18, T6, T8, D11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators import aggregates as agg
from ..operators import feed
from ..operators.dedupe import analysis_clean
from ..operators.store import get_or_create_sources, register_keywords
from ..operators.tfidf import corpus_stats, term_counts, trending_keywords, vocabulary
from ..session import scratch_path
from ..sources.sinks import CSV_OPTIONS, export_csv, export_json
from ..sources.tables import (ARTICLES_SCHEMA, articles_view, insert_defaults, raw_batch_view, read_or_empty,
                              read_raw_batch, read_table)
from .cleaning import SEARCH
from .registry import ARTICLES_CTE, hash_sql, r6, register, stop_sql, ts_text
from .textual import ALL_TEXTS, tfidf_sql

FOUND_SQL = f"""(coalesce(regexp_matches(title, '{SEARCH}', 'i'), false) OR coalesce(regexp_matches(content, '{SEARCH}', 'i'), false)
       OR coalesce(regexp_matches(source, '{SEARCH}', 'i'), false))"""
FEED_JSON = ["title", "content", "source", "category", "sentiment_score"]
FULL_COLUMNS = ["title", "content", "source", "date", "category", "sentiment_score"]


@register("raw_batch", "S5,F18,F4,S2", f"""
SELECT doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS content, NULL::VARCHAR AS url, source,
       CASE WHEN doc_id % 3 = 0 THEN '' ELSE {hash_sql('text')} END AS content_hash, '' AS alt_sources,
       0.0::DOUBLE AS sentiment_score
FROM documents""")
def q_raw_batch(spark, sf_dir):
    """The documents as a JSON batch whose records lack fields; a batch that is not there adds nothing."""
    path = scratch_path(spark, "raw_batch")
    raw = raw_batch_view(spark, sf_dir).withColumn("content", F.when(F.col("seq") % 3 != 0, F.col("content")))
    raw.withColumn("unknown_field", F.lit(1)).write.json(path)  # NULL fields are left out of the records
    batch = read_raw_batch(spark, path).unionByName(read_raw_batch(spark, path + "-missing"))
    hashed = batch.withColumn("content_hash", F.when(F.col("content").isNotNull(), content_hash("content")))
    return insert_defaults(hashed).select("seq", "content", "url", "source", "content_hash", "alt_sources", "sentiment_score")


@register("feed_export_csv", "S10,S9,D10", f"""
WITH {ARTICLES_CTE.strip()}
SELECT id, title, content, source, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, category, sentiment_score
FROM articles WHERE {FOUND_SQL} AND sentiment_score > 0.1""")
def q_feed_export_csv(spark, sf_dir):
    """The whole filtered feed (not the page shown) as CSV, read back."""
    path = scratch_path(spark, "feed_csv")
    found = feed.filtered(articles_view(spark, sf_dir), search=SEARCH, bucket="Positive")
    if not export_csv(found, path):
        return found
    back = spark.read.options(**CSV_OPTIONS, multiLine="true").schema(found.schema).csv(path)
    return back.withColumn("date", ts_text("date"))


@register("feed_export_json", "S10,D10", f"""
WITH {ARTICLES_CTE.strip()}
SELECT {', '.join(FEED_JSON)} FROM articles WHERE {FOUND_SQL} AND sentiment_score > 0.1""")
def q_feed_export_json(spark, sf_dir):
    path = scratch_path(spark, "feed_json")
    found = feed.filtered(articles_view(spark, sf_dir), search=SEARCH, bucket="Positive")
    export_json(found, path, FEED_JSON)
    return spark.read.schema(found.select(*FEED_JSON).schema).json(path)


@register("full_export_csv", "S11,S9", f"""
WITH {ARTICLES_CTE.strip()}
SELECT title, content, source, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, category, sentiment_score FROM articles""")
def q_full_export_csv(spark, sf_dir):
    path = scratch_path(spark, "full_csv")
    arts = articles_view(spark, sf_dir).select(*FULL_COLUMNS)
    if not export_csv(arts, path):
        return arts
    return spark.read.options(**CSV_OPTIONS, multiLine="true").schema(arts.schema).csv(path).withColumn("date", ts_text("date"))


@register("export_no_file", "S9,S2", """
SELECT name, n > 0 AS written, n AS rows_back
FROM (SELECT 'src3' AS name, count(*) FILTER (source = 'src3') AS n FROM documents
      UNION ALL SELECT 'no such source', count(*) FILTER (source = 'no such source') FROM documents)""")
def q_export_no_file(spark, sf_dir):
    """An empty export writes no file; what is not there reads as an empty table."""
    out = []
    arts = articles_view(spark, sf_dir).withColumn("url", F.lit(None).cast("string"))
    for name in ("src3", "no such source"):
        path = scratch_path(spark, "export")
        written = export_csv(feed.source_filter(arts, name), path, FULL_COLUMNS)
        back = spark.read.options(**CSV_OPTIONS, multiLine="true").schema(arts.select(*FULL_COLUMNS).schema).csv(path) if written \
            else read_or_empty(spark, path, ARTICLES_SCHEMA)
        out.append(back.agg(F.lit(name).alias("name"), F.lit(written).alias("written"), F.count(F.lit(1)).alias("rows_back")))
    return out[0].unionByName(out[1])


@register("lenient_dates", "F7,D6", """
SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN strftime(TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S')
                          WHEN doc_id % 4 = 1 THEN strftime(TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR, '%Y-%m-%d') || ' 00:00:00' END AS date,
       coalesce(lang, 'Unknown') AS category
FROM documents WHERE text IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY split_part(text, chr(10), 1), source ORDER BY doc_id) = 1""")
def q_lenient_dates(spark, sf_dir):
    """Dates as text: a timestamp, a day, something else or nothing."""
    arts = articles_view(spark, sf_dir)
    k = F.col("id") % 4
    arts = arts.withColumn("date", F.when(k == 0, ts_text("date")).when(k == 1, F.date_format("date", "yyyy-MM-dd")).when(k == 2, F.lit("yesterday, 5 pm")))
    return analysis_clean(arts).select("id", ts_text("date").alias("date"), "category")


@register("capped_vocabulary", "T6,A10", f"""
WITH {tfidf_sql(ALL_TEXTS, 5000).strip()}
SELECT term, df FROM vocab""")
def q_capped_vocabulary(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return vocabulary(corpus_stats(term_counts(docs)), 5000).select("term", "df")


@register("trending_capped", "T6,D8,T5", f"""
WITH {tfidf_sql(ALL_TEXTS, 100).strip()}
SELECT term AS keyword, round(sum(weight), 6) AS trend_score FROM w
GROUP BY term ORDER BY trend_score DESC, keyword LIMIT 15""")
def q_trending_capped(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return trending_keywords(docs, "content", top=15, cap=100, id_col="id", digits=6)


@register("sorted_as_text", "T8", """
SELECT row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) AS place, doc_id AS id FROM documents
QUALIFY place <= 100""")
def q_sorted_as_text(spark, sf_dir):
    """The first hundred ids in the order of their text."""
    first = feed.sort_as_text(articles_view(spark, sf_dir).select("id"), "id").limit(100)
    rows = first.agg(F.collect_list("id").alias("ids"))  # 100 rows, sorted again by the text
    ordered = F.array_sort(F.transform("ids", lambda x: F.struct(x.cast("string").alias("t"), x.alias("id"))))
    return rows.select(F.posexplode(ordered).alias("p", "x")).select((F.col("p") + 1).cast("long").alias("place"), "x.id")


@register("dashboard_data", "D11,A1,A4,A5,A6,A9", f"""
WITH {ARTICLES_CTE.strip()},
words AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS keyword FROM articles),
freq AS (SELECT keyword, count(*) AS n FROM words WHERE keyword NOT IN ({stop_sql()}) GROUP BY keyword ORDER BY n DESC, keyword LIMIT 50)
SELECT 'stats' AS section, 'total_articles' AS name, count(*) AS n, round(avg(sentiment_score), 4) AS score FROM articles
UNION ALL SELECT 'timeline', strftime(date, '%Y-%m-%d'), count(sentiment_score), round(avg(sentiment_score), 6) FROM articles GROUP BY 2
UNION ALL SELECT 'sources', source, count(*), round(avg(sentiment_score), 6) FROM articles WHERE source IS NOT NULL GROUP BY source
UNION ALL SELECT 'categories', category, count(*), NULL FROM articles WHERE category IS NOT NULL GROUP BY category
UNION ALL SELECT 'keywords', keyword, n, NULL FROM freq""")
def q_dashboard_data(spark, sf_dir):
    """The main dashboard's frames as one table."""
    arts = articles_view(spark, sf_dir)
    sources = get_or_create_sources(raw_batch_view(spark, sf_dir))
    keywords, bridge = register_keywords(arts)
    b = agg.dashboard_bundle(arts, sources, keywords, bridge)
    none = F.lit(None).cast("double")
    parts = [("stats", b["stats"], F.lit("total_articles"), "total_articles", F.col("avg_sentiment")),
             ("timeline", b["timeline"], F.date_format("day", "yyyy-MM-dd"), "total", r6("avg_score")),
             ("sources", b["sources"], F.col("source"), "article_count", r6("avg_sentiment")),
             ("categories", b["categories"], F.col("category"), "article_count", none),
             ("keywords", b["keywords"], F.col("keyword"), "frequency", none)]
    out = [df.select(F.lit(s).alias("section"), n.alias("name"), F.col(c).cast("long").alias("n"), v.alias("score")) for s, df, n, c, v in parts]
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole
