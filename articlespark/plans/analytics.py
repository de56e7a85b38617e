"""Registered analytics queries: store/enrichment, dashboard and report
aggregates (S1, J1, J6, A1-A8, A13, A14, A16, D9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators.store import enrich, get_or_create_sources
from ..sources.tables import articles_view, events_view, raw_batch_view, read_table
from .registry import ARTICLES_CTE, EVENTS_CTE, SOURCES_CTE, day_text, r6, register, ts_text


def store_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The article store built from ``documents``: sources (J6) and articles
    carrying ``source_id``."""
    raw = raw_batch_view(spark, sf_dir)
    sources = get_or_create_sources(raw)
    arts = articles_view(spark, sf_dir)
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    articles = arts.join(s, "source").drop("source")
    return {"sources": sources, "articles": articles}


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = store_tables(spark, sf_dir)
    return enrich(t["articles"], t["sources"])


@register("source_dimension", "J6,D13", f"""
WITH {SOURCES_CTE.strip()}
SELECT id, name, url FROM sources""")
def q_source_dimension(spark, sf_dir):
    return store_tables(spark, sf_dir)["sources"]


@register("articles_enriched", "S1,J1,J6", f"""
WITH {ARTICLES_CTE.strip()}, {SOURCES_CTE.strip()}
SELECT a.id, a.title, a.content, s.name AS source,
       strftime(a.date, '%Y-%m-%d %H:%M:%S') AS date, a.category, a.sentiment_score
FROM articles a JOIN sources s ON a.source = s.name""")
def q_articles_enriched(spark, sf_dir):
    return enriched(spark, sf_dir).withColumn("date", ts_text("date"))


@register("source_comparison", "A5", f"""
WITH {ARTICLES_CTE.strip()}
SELECT source, count(id) AS article_count, round(avg(sentiment_score), 6) AS avg_sentiment
FROM articles WHERE source IS NOT NULL GROUP BY source""")
def q_source_comparison(spark, sf_dir):
    return agg.source_comparison(articles_view(spark, sf_dir), digits=6)


def _stats(spark, sf_dir):
    from ..operators.store import register_keywords

    t = store_tables(spark, sf_dir)
    arts = enrich(t["articles"], t["sources"])
    kw, _ = register_keywords(arts)
    return agg.store_stats(arts, t["sources"], kw, digits=6)


KEYWORDS_SQL_CTE = """
kw AS (
  SELECT DISTINCT k AS keyword FROM (
    SELECT unnest(regexp_extract_all(lower(coalesce(title, '')), '[\\p{L}\\p{N}_]{2,}')) AS k
    FROM articles) WHERE k NOT IN (__STOP__))"""


def _stop_sql() -> str:
    from ..functions.stopwords import ENGLISH_STOPWORDS

    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(ENGLISH_STOPWORDS))


@register("store_stats", "A1,D14", f"""
WITH {ARTICLES_CTE.strip()}, {SOURCES_CTE.strip()}, {KEYWORDS_SQL_CTE.strip().replace('__STOP__', _stop_sql())}
SELECT count(*) AS total_articles,
       (SELECT count(*) FROM sources) AS total_sources,
       (SELECT count(*) FROM kw) AS total_keywords,
       coalesce(round(avg(sentiment_score), 6), 0.0) AS avg_sentiment,
       count_if(sentiment_score > 0.1) AS pos_count,
       count_if(sentiment_score < -0.1) AS neg_count,
       count(*) - count_if(sentiment_score > 0.1) - count_if(sentiment_score < -0.1) AS neut_count
FROM articles""")
def q_store_stats(spark, sf_dir):
    return _stats(spark, sf_dir)


def _pct_sql(num: str, den: str) -> str:
    """SQL twin of aggregates.exact_pct with digits=1."""
    x = f"(({num}) * 1000)"
    d = f"({den})"
    q = f"(({x} - {x} % {d}) // {d})"
    r = f"({x} % {d})"
    return (f"(({q} + CASE WHEN {r} * 2 > {d} OR ({r} * 2 = {d} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
            f" / 10.0::DOUBLE)")


@register("sentiment_index", "A14", f"""
WITH {ARTICLES_CTE.strip()},
s AS (SELECT count(*) AS total, count_if(sentiment_score > 0.1) AS pos,
             count_if(sentiment_score < -0.1) AS neg FROM articles),
p AS (SELECT {_pct_sql('pos', 'greatest(total, 1)')} AS pos_pct,
             {_pct_sql('neg', 'greatest(total, 1)')} AS neg_pct FROM s)
SELECT pos_pct, neg_pct, round(100.0::DOUBLE - pos_pct - neg_pct, 1) AS neu_pct FROM p""")
def q_sentiment_index(spark, sf_dir):
    arts = articles_view(spark, sf_dir)
    return agg.sentiment_index(agg.sentiment_counts(arts))


@register("report_summary", "A2,D9,P11,F17", f"""
WITH {ARTICLES_CTE.strip()}
SELECT '2024-02-15' AS report_date, count(*) AS total_articles,
       round(avg(sentiment_score), 6) AS average_sentiment,
       count(DISTINCT source) AS sources_analyzed,
       count_if(sentiment_score > 0.1) AS positive,
       count_if(sentiment_score >= -0.1 AND sentiment_score <= 0.1) AS neutral,
       count_if(sentiment_score < -0.1) AS negative
FROM articles HAVING count(*) > 0""")
def q_report_summary(spark, sf_dir):
    return agg.report_summary(articles_view(spark, sf_dir), "2024-02-15", digits=6, nested=False)


@register("daily_sentiment", "A3,F14,P10", f"""
WITH {EVENTS_CTE.strip()}
SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, round(avg(score), 6) AS avg_score
FROM ev WHERE ts IS NOT NULL GROUP BY ts::DATE""")
def q_daily_sentiment(spark, sf_dir):
    ev = events_view(spark, sf_dir)
    return agg.daily_mean(ev, "ts", "score", digits=6).withColumn("day", day_text("day"))


@register("daily_sentiment_ratio", "A4", f"""
WITH {EVENTS_CTE.strip()}
SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, round(avg(score), 6) AS avg_score,
       count_if(score > 0.1) AS pos, count_if(score < -0.1) AS neg, count(score) AS total,
       round(count_if(score > 0.1) / count(score)::DOUBLE, 6) AS pos_ratio,
       round(count_if(score < -0.1) / count(score)::DOUBLE, 6) AS neg_ratio
FROM ev WHERE ts IS NOT NULL GROUP BY ts::DATE""")
def q_daily_sentiment_ratio(spark, sf_dir):
    ev = events_view(spark, sf_dir)
    return agg.daily_sentiment_ratio(ev, "ts", "score", digits=6).withColumn("day", day_text("day"))


@register("category_share", "A6,T7", f"""
WITH {ARTICLES_CTE.strip()},
c AS (SELECT category, count(*) AS article_count FROM articles
      WHERE category IS NOT NULL GROUP BY category),
t AS (SELECT category, article_count, sum(article_count) OVER () AS total FROM c)
SELECT category, article_count, {_pct_sql('article_count', 'total')} AS share_pct FROM t""")
def q_category_share(spark, sf_dir):
    return agg.category_share(articles_view(spark, sf_dir))


PIVOT_SOURCES = [f"src{k}" for k in range(20)]


@register("category_source_pivot", "A7", f"""
SELECT lang AS category, {', '.join(f"round(avg(score) FILTER (source = '{s}'), 6) AS {s}" for s in PIVOT_SOURCES)}
FROM (SELECT lang, source, ((doc_id * 37) % 201 - 100) / 100.0::DOUBLE AS score FROM documents WHERE lang IS NOT NULL)
GROUP BY lang""")
def q_category_source_pivot(spark, sf_dir):
    return agg.category_source_pivot(articles_view(spark, sf_dir), PIVOT_SOURCES, digits=6)


@register("boxplot_stats", "A8", f"""
WITH {EVENTS_CTE.strip()},
q AS (SELECT source, count(score) AS n,
             quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median,
             quantile_cont(score, 0.75) AS q3
      FROM ev WHERE score IS NOT NULL GROUP BY source),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence,
             q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
SELECT f.source, f.n, round(f.q1, 6) AS q1, round(f.median, 6) AS median, round(f.q3, 6) AS q3,
       round(f.iqr, 6) AS iqr, round(f.lower_fence, 6) AS lower_fence,
       round(f.upper_fence, 6) AS upper_fence,
       round(min(e.score) FILTER (WHERE e.score BETWEEN f.lower_fence AND f.upper_fence), 6) AS whisker_low,
       round(max(e.score) FILTER (WHERE e.score BETWEEN f.lower_fence AND f.upper_fence), 6) AS whisker_high,
       count_if(NOT (e.score BETWEEN f.lower_fence AND f.upper_fence)) AS n_outliers
FROM f JOIN ev e ON e.source = f.source AND e.score IS NOT NULL
GROUP BY f.source, f.n, f.q1, f.median, f.q3, f.iqr, f.lower_fence, f.upper_fence""")
def q_boxplot_stats(spark, sf_dir):
    ev = events_view(spark, sf_dir)
    out = agg.boxplot_stats(ev, "source", "score")
    return out.select("source", "n", *[r6(c).alias(c) for c in (
        "q1", "median", "q3", "iqr", "lower_fence", "upper_fence", "whisker_low", "whisker_high")],
        "n_outliers")


@register("table_sizes", "A13,S2", """
SELECT 'documents' AS table_name, count(*) AS row_count FROM documents
UNION ALL SELECT 'events', count(*) FROM events
UNION ALL SELECT 'pages', count(*) FROM pages
UNION ALL SELECT 'labels', count(*) FROM labels""")
def q_table_sizes(spark, sf_dir):
    return agg.table_sizes({n: read_table(spark, sf_dir, n) for n in ("documents", "events", "pages", "labels")})


@register("distinct_sources", "A16", """
SELECT DISTINCT source FROM documents WHERE source IS NOT NULL""")
def q_distinct_sources(spark, sf_dir):
    return agg.distinct_sources(read_table(spark, sf_dir, "documents"))
