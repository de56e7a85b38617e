"""Feed-style filters and the feed query.

The feed is one lazy DataFrame: Catalyst pushes the source / date / score
predicates into the parquet scan and only the page (``limit``) reaches the
driver when the caller collects it.  Exports (S10) use the un-limited frame.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sentiment import sentiment_label
from ..functions.text import snippet, time_text

# The dashboard's source-language groups.
LANGUAGE_SOURCES = {
    "Vietnamese": ("VnExpress", "Tuoi Tre", "Thanh Nien"),
    "English": ("BBC", "Reuters", "CNN"),
}


def recent(df: DataFrame, now, hours: float = 72, date_col: str = "date") -> DataFrame:
    """Rows with ``date >= now - hours`` (NULL dates never qualify)."""
    lo = F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(float(hours) * 3600))
    return df.where(F.col(date_col) >= lo)


def search_filter(df: DataFrame, query: str | None,
                  columns: Sequence[str] = ("title", "content", "source"),
                  literal: bool = False) -> DataFrame:
    """Case-insensitive regex (or literal substring) match on any of
    ``columns``; NULL never matches; empty query = no filter."""
    if not query:
        return df
    cond: Column = F.lit(False)
    for c in columns:
        if literal:
            m = F.instr(F.lower(F.col(c)), query.lower()) > 0
        else:
            m = F.col(c).rlike("(?iu)" + query)
        cond = cond | F.coalesce(m, F.lit(False))
    return df.where(cond)


def source_filter(df: DataFrame, source: str | None) -> DataFrame:
    """P5: exact source; None / 'All' / 'All Sources' = no filter."""
    if not source or source in ("All", "All Sources"):
        return df
    return df.where(F.col("source") == source)


def bucket_filter(df: DataFrame, bucket: str | None, threshold: float = 0.1,
                  score: str = "sentiment_score") -> DataFrame:
    """Positive > t, Negative < -t, Neutral -t..t inclusive; NULL in none."""
    s = F.col(score)
    if bucket == "Positive":
        return df.where(s > threshold)
    if bucket == "Negative":
        return df.where(s < -threshold)
    if bucket == "Neutral":
        return df.where(s.between(-threshold, threshold))
    return df


def language_filter(df: DataFrame, language: str | None,
                    source_lang: DataFrame | None = None,
                    groups: dict[str, Iterable[str]] | None = None) -> DataFrame:
    """P8 + J9: keep articles whose source belongs to ``language``.

    With ``source_lang`` (a ``source, lang`` table) this is a left-semi join;
    otherwise an ``isin`` over a fixed group of names (default: the
    dashboard's groups).
    """
    if not language or language == "All":
        return df
    if source_lang is not None:
        keep = source_lang.where(F.col("lang") == language).select("source")
        return df.join(keep, "source", "left_semi")
    names = list((groups or LANGUAGE_SOURCES).get(language, ()))
    return df.where(F.col("source").isin(names))


def date_range(df: DataFrame, lo, hi, date_col: str = "date") -> DataFrame:
    """Calendar day of ``date`` within [lo, hi] inclusive.  The bare column is
    compared, so the filter reaches the scan."""
    first = F.to_date(F.lit(lo)).cast("timestamp")
    after = F.date_add(F.to_date(F.lit(hi)), 1).cast("timestamp")
    return df.where((F.col(date_col) >= first) & (F.col(date_col) < after))


def filtered(df: DataFrame, search: str | None = None, source: str | None = None,
             bucket: str | None = None, language: str | None = None,
             source_lang: DataFrame | None = None) -> DataFrame:
    """D10 filter part: all filters ANDed (the un-limited, exportable set)."""
    out = search_filter(df, search)
    out = source_filter(out, source)
    out = bucket_filter(out, bucket)
    return language_filter(out, language, source_lang)


def feed_page(df: DataFrame, now, limit: int = 50, **filters) -> DataFrame:
    """Newest first (T1), filtered, first ``limit`` rows (T3), with
    snippet (F8), label (F6) and timestamp text (F9) -- projection P12."""
    page = filtered(df, **filters).orderBy(F.desc("id")).limit(limit)
    return page.select(
        "source", "title", snippet("content").alias("snippet"), "category",
        sentiment_label("sentiment_score").alias("sentiment"), "sentiment_score",
        time_text("date", now).alias("timestamp"))


def feed_counters(df: DataFrame, limit: int = 50, **filters) -> DataFrame:
    """``showing = min(n, limit)`` and ``n`` for the filtered set."""
    n = filtered(df, **filters).agg(F.count(F.lit(1)).alias("total"))
    return n.select(F.least(F.col("total"), F.lit(limit)).alias("showing"), "total")


def hero_counters(df: DataFrame) -> DataFrame:
    """A15 (cards): number of articles and of distinct sources."""
    return df.agg(F.count(F.lit(1)).alias("articles"), F.countDistinct("source").alias("sources"))


def card_fields(df: DataFrame) -> DataFrame:
    """F19 + F6 (cards policy): browser-card defaults -- empty/NULL category
    reads 'NEWS', NULL score reads 0, label at +-0.2."""
    score = F.coalesce(F.col("sentiment_score"), F.lit(0.0))
    return df.select(
        "id", "title", "source",
        F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("NEWS")).alias("category"),
        score.alias("score"), sentiment_label(score, 0.2).alias("label"))


def sort_as_text(df: DataFrame, col: str) -> DataFrame:
    """Order by the string form of a column (mixed-type sort)."""
    return df.orderBy(F.col(col).cast("string"))
