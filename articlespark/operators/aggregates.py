"""Dashboard and report aggregates (A1-A16) over enriched articles.

Each function takes DataFrames and returns a DataFrame; nothing is collected.
Scores: ``> 0.1`` positive, ``< -0.1`` negative (the reference's thresholds).
Averages are rounded half-even (F17) with ``digits`` (the reference shows 4); percentages of
counts are rounded exactly from the integer ratio (half-even, like Python's
``round`` on the exact quotient), so the result never depends on float noise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_words
from .boxplot import box_statistics

POS, NEG = 0.1, -0.1


def exact_pct(num: Column, den: Column, digits: int = 1) -> Column:
    """``round(100 * num / den, digits)`` computed with integers, half-even.

    NULL when ``den`` is 0.  Works for non-negative ``num`` and positive ``den``.
    """
    scale = 10 ** (digits + 2)
    x = num.cast("long") * F.lit(scale)
    d = den.cast("long")
    r = x % d
    q = ((x - r) / d).cast("long")  # exact: x - r is a multiple of d, < 2^53
    up = (r * 2 > d) | ((r * 2 == d) & (q % 2 == 1))
    q = q + F.when(up, 1).otherwise(0)
    return F.when(d > 0, q / F.lit(float(10 ** digits)))


def score_counts(score: str = "sentiment_score") -> list[Column]:
    s = F.col(score)
    return [F.count_if(s > POS).alias("pos_count"), F.count_if(s < NEG).alias("neg_count")]


def store_stats(articles: DataFrame, sources: DataFrame, keywords: DataFrame,
                digits: int = 4) -> DataFrame:
    """A1: one row of store statistics; an empty store gives zeros."""
    s = F.col("sentiment_score")
    base = articles.agg(
        F.count(F.lit(1)).alias("total_articles"),
        F.avg(s).alias("_avg"),
        *score_counts(),
    )
    return base.select(
        "total_articles",
        sources.select(F.count(F.lit(1))).scalar().alias("total_sources"),
        keywords.select(F.count(F.lit(1))).scalar().alias("total_keywords"),
        F.coalesce(F.bround("_avg", digits), F.lit(0.0)).alias("avg_sentiment"),
        "pos_count", "neg_count",
        (F.col("total_articles") - F.col("pos_count") - F.col("neg_count")).alias("neut_count"),
    )


def sentiment_counts(articles: DataFrame) -> DataFrame:
    """Input of A14: all, positive and negative articles, in one scan."""
    return articles.agg(F.count(F.lit(1)).alias("total_articles"), *score_counts())


def sentiment_index(stats: DataFrame, digits: int = 1) -> DataFrame:
    """Positive / negative share in percent over max(total, 1); neutral is
    the remainder."""
    den = F.greatest(F.col("total_articles"), F.lit(1))
    pos = exact_pct(F.col("pos_count"), den, digits)
    neg = exact_pct(F.col("neg_count"), den, digits)
    return stats.select(
        pos.alias("pos_pct"), neg.alias("neg_pct"),
        F.round(F.lit(100.0) - pos - neg, digits).alias("neu_pct"),
    )


def report_summary(df: DataFrame, report_date: str, digits: int = 4,
                   nested: bool = True) -> DataFrame:
    """A2: daily report summary; zero rows for an empty input."""
    s = F.col("sentiment_score")
    agg = df.agg(
        F.count(F.lit(1)).alias("total_articles"),
        F.bround(F.avg(s), digits).alias("average_sentiment"),
        F.countDistinct("source").alias("sources_analyzed"),
        F.count_if(s > POS).alias("positive"),
        F.count_if((s >= NEG) & (s <= POS)).alias("neutral"),
        F.count_if(s < NEG).alias("negative"),
    ).where(F.col("total_articles") > 0)
    head = [F.lit(report_date).alias("report_date"), "total_articles", "average_sentiment", "sources_analyzed"]
    if nested:
        return agg.select(*head, F.struct("positive", "neutral", "negative").alias("sentiment_breakdown"))
    return agg.select(*head, "positive", "neutral", "negative")


def daily_mean(df: DataFrame, ts: str = "date", score: str = "sentiment_score",
               digits: int | None = None) -> DataFrame:
    """A3: mean score per calendar day (F14), NULL dates skipped (P10)."""
    avg = F.avg(score)
    return (df.where(F.col(ts).isNotNull())
            .groupBy(F.to_date(ts).alias("day"))
            .agg((F.round(avg, digits) if digits is not None else avg).alias("avg_score")))


def daily_sentiment_ratio(df: DataFrame, ts: str = "date", score: str = "sentiment_score",
                          digits: int | None = None) -> DataFrame:
    """A4: per day average, positive/negative counts, non-null count and the
    two ratios (NULL when a day has no scored rows)."""
    s = F.col(score)
    rnd = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return (df.where(F.col(ts).isNotNull())
            .groupBy(F.to_date(ts).alias("day"))
            .agg(rnd(F.avg(s)).alias("avg_score"),
                 F.count_if(s > POS).alias("pos"),
                 F.count_if(s < NEG).alias("neg"),
                 F.count(s).alias("total"))
            .withColumn("pos_ratio", rnd(F.try_divide(F.col("pos"), F.col("total"))))
            .withColumn("neg_ratio", rnd(F.try_divide(F.col("neg"), F.col("total")))))


def source_comparison(df: DataFrame, digits: int | None = None) -> DataFrame:
    """A5: per source article count and mean score."""
    avg = F.avg("sentiment_score")
    return (df.where(F.col("source").isNotNull()).groupBy("source")
            .agg(F.count("id").alias("article_count"),
                 (F.round(avg, digits) if digits is not None else avg).alias("avg_sentiment")))


def category_share(df: DataFrame, digits: int = 1) -> DataFrame:
    """A6 + T7: category counts (NULL excluded) and percent share, count desc.

    The share uses a window over the grouped counts: one row per category.
    """
    counts = df.where(F.col("category").isNotNull()).groupBy("category").agg(
        F.count(F.lit(1)).alias("article_count"))
    total = F.sum("article_count").over(Window.partitionBy())
    return (counts.withColumn("share_pct", exact_pct(F.col("article_count"), total, digits))
            .orderBy(F.desc("article_count"), "category"))


def category_source_pivot(df: DataFrame, sources: Sequence[str] | None = None,
                          digits: int | None = None) -> DataFrame:
    """rows = category, columns = source, cells = mean score.

    Pass ``sources`` to fix the columns; otherwise Spark collects the distinct
    source names (bounded by the source dimension, capped by
    ``spark.sql.pivotMaxValues``).
    """
    avg = F.avg("sentiment_score")
    cell = F.round(avg, digits) if digits is not None else avg
    g = df.where(F.col("category").isNotNull()).groupBy("category")
    piv = g.pivot("source", list(sources)) if sources is not None else g.pivot("source")
    return piv.agg(cell)


def boxplot_stats(df: DataFrame, group: str = "source", value: str = "sentiment_score") -> DataFrame:
    """Box-plot statistics per group (seaborn/matplotlib rule): quartiles
    by linear interpolation, fences at 1.5 IQR, whiskers at the most extreme
    values inside the fences, count of points outside."""
    return box_statistics(df, group, value)


def keyword_frequency(keywords: DataFrame, article_keywords: DataFrame, top: int | None = 50) -> DataFrame:
    """A9 + J2 + T2: articles per keyword, most frequent first (ties by keyword)."""
    freq = (keywords.join(article_keywords, keywords["id"] == article_keywords["keyword_id"])
            .groupBy("keyword").agg(F.count("article_id").alias("frequency")))
    ordered = freq.orderBy(F.desc("frequency"), "keyword")
    return ordered.limit(top) if top else ordered


def title_word_counts(df: DataFrame, top: int | None = 30) -> DataFrame:
    """A12 + T4: word frequency over titles (F13 cleaning); ties keep first
    encounter order, reading articles newest first (id desc)."""
    words = (df.where(F.col("title").isNotNull())
             .select("id", F.posexplode(title_words("title")).alias("pos", "word")))
    freq = words.groupBy("word").agg(
        F.count(F.lit(1)).alias("count"),
        F.min(F.struct((-F.col("id")).alias("k"), F.col("pos").alias("p"))).alias("first_seen"))
    ordered = freq.orderBy(F.desc("count"), "first_seen.k", "first_seen.p").select("word", "count")
    return ordered.limit(top) if top else ordered


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table, as one small union of counts."""
    parts = [df.select(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
             .groupBy("table_name").agg(F.sum("row_count").cast("long").alias("row_count"))
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_sources(df: DataFrame) -> DataFrame:
    """Sorted distinct non-null source names."""
    return df.select("source").where(F.col("source").isNotNull()).distinct().orderBy("source")


def dashboard_bundle(articles: DataFrame, sources: DataFrame, keywords: DataFrame,
                     article_keywords: DataFrame) -> dict[str, DataFrame]:
    """The main dashboard's data -- lazily planned frames over one cached
    article set; keyword frequency falls back to title words when the
    keyword tables are empty (checked with one ``isEmpty`` job)."""
    arts = articles.cache()
    kw_freq = (title_word_counts(arts) if keywords.isEmpty()
               else keyword_frequency(keywords, article_keywords))
    return {
        "stats": store_stats(arts, sources, keywords),
        "timeline": daily_sentiment_ratio(arts),
        "sources": source_comparison(arts),
        "categories": category_share(arts),
        "keywords": kw_freq,
    }
