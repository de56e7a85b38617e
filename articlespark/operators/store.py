"""Article store operators: dimension ids, enrichment join, upsert, score
write-back, purge, keyword registration (J1, J6, J7, D4, D12, D13, D14).

Parquet has no MERGE, so every write is a whole new version of the table: the
caller writes the returned DataFrame to a fresh path and then switches its
pointer; an input path is never overwritten while it is being read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stopwords import ENGLISH_STOPWORDS
from ..functions.text import fold_sources, tokens
from ..session import ensure_checkpoint_dir, spread
from .dedupe import keep_first
from .ids import dense_ids
from ..sources.tables import (ARTICLE_KEYWORDS_SCHEMA, ARTICLES_SCHEMA, KEYWORDS_SCHEMA,
                              SOURCES_SCHEMA)


def empty_store(spark: SparkSession) -> dict[str, DataFrame]:
    """The four store tables, empty, with their declared schemas."""
    return {
        "sources": spark.createDataFrame([], SOURCES_SCHEMA),
        "articles": spark.createDataFrame([], ARTICLES_SCHEMA),
        "keywords": spark.createDataFrame([], KEYWORDS_SCHEMA),
        "article_keywords": spark.createDataFrame([], ARTICLE_KEYWORDS_SCHEMA),
    }


def get_or_create_sources(batch: DataFrame, sources: DataFrame | None = None,
                          name: str = "source", url: str = "source_url",
                          order: str = "seq") -> DataFrame:
    """The source dimension after adding the batch's unknown names.

    Known names keep their id; new names get ``max(id) + rank`` in name order
    and the url of their first record (numbered by ``dense_ids``).
    """
    firsts = (batch.where(F.col(name).isNotNull())
              .groupBy(F.col(name).alias("name"))
              .agg(F.min_by(F.coalesce(F.col(url), F.lit("")), F.col(order)).alias("url")))
    if sources is None:
        new = firsts
        base = F.lit(0).cast("long")
        known = None
    else:
        new = firsts.join(sources.select("name"), "name", "left_anti")
        base = sources.select(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
        known = sources.select("id", "name", "url")
    new_ids = dense_ids(new, ["name"], start=base + 1).select("id", "name", "url")
    return new_ids if known is None else known.unionByName(new_ids)


def enrich(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """S1 + J1: articles joined to their source name (inner, like the reference:
    articles with an unknown source drop out)."""
    a, s = articles.alias("a"), sources.alias("s")
    return a.join(s, F.col("a.source_id") == F.col("s.id")).select(
        "a.id", "a.title", "a.content", F.col("s.name").alias("source"),
        "a.date", "a.category", "a.sentiment_score")


def write_back_scores(articles: DataFrame, scores: DataFrame, key: str = "id",
                      score: str = "score") -> DataFrame:
    """New score where one was computed, else the old one."""
    s = scores.select(F.col(key).alias("_k"), F.col(score).alias("_new"))
    return (articles.join(s, articles[key] == s["_k"], "left")
            .withColumn("sentiment_score", F.coalesce("_new", "sentiment_score"))
            .drop("_k", "_new"))


def purge(articles: DataFrame, now, days: int = 30, date_col: str = "date") -> tuple[DataFrame, DataFrame]:
    """Delete rows whose calendar date is strictly before ``now - days``.

    NULL dates are kept (SQL comparison semantics).  Returns ``(kept, deleted)``.
    """
    cutoff = F.date_sub(F.to_date(F.lit(now).cast("timestamp")), days)
    d = F.col(date_col)  # bare, so the filter reaches the scan
    gone = d < cutoff.cast("timestamp")
    return articles.where(~gone | d.isNull()), articles.where(gone)


def prune_bridge(article_keywords: DataFrame, kept_articles: DataFrame) -> DataFrame:
    """D12 companion: keep only keyword links whose article survived a purge
    (a left-semi join; the reference leaves them orphaned)."""
    return article_keywords.join(kept_articles.select(F.col("id").alias("article_id")), "article_id",
                                 "left_semi")


def _new_keys(store: DataFrame, batch: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Narrow ``(order, content_hash, url)`` rows of the batch whose hash the
    store does not hold: those that may be inserted, and those refused because
    their url belongs to another article.  Both read one checkpointed decision."""
    ensure_checkpoint_dir(batch.sparkSession)
    new = (batch.select(order, "content_hash", F.nullif("url", F.lit("")).alias("url"))
           .join(store.select("content_hash"), "content_hash", "left_anti"))
    stored = store.where("url <> ''").groupBy("url").agg(F.lit(None).cast(new.schema[order].dataType).alias("_by"),
                                                         F.min("content_hash").alias("_owner"))
    claimed = (new.where("url IS NOT NULL").groupBy("url")
               .agg(F.min(order).alias("_by"), F.min_by("content_hash", order).alias("_owner"))
               .join(stored.select("url"), "url", "left_anti"))
    owners = stored.unionByName(claimed)
    # the owner itself and later copies of its text are no conflict
    same = F.col("_by").eqNullSafe(F.col(order)) | F.coalesce(F.col("content_hash") == F.col("_owner"), F.lit(False))
    decided = (new.join(owners.withColumn("_taken", F.lit(True)), "url", "left")
               .select(order, "content_hash", "url", (F.col("_taken").isNotNull() & ~same).alias("_refused")).checkpoint())
    return decided.where("NOT _refused").drop("_refused"), decided.where("_refused").select(order)


def numbered_insertions(new: DataFrame, store: DataFrame, order: str) -> DataFrame:
    """``(order, id)``: the first row of each new hash (NULL hashes stay apart) and
    its id, ``max(store id) + rank``."""
    base = store.select(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    first = keep_first(new, ["content_hash"], order, null_keys="distinct").select(order)
    return dense_ids(first, [order], start=base + 1)


def insertions(store: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """D4, its insert half: the batch's rows that ``upsert`` inserts, whole and with
    their new ids.  Of the store only the columns id, content_hash and url are read."""
    new, _ = _new_keys(store, batch, order)
    return batch.drop("id").join(numbered_insertions(new, store, order), order)


def upsert_rejects(store: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """The batch rows that ``upsert`` refuses, whole: their hash is new, but
    their (non-empty) url is stored, or claimed by an earlier new batch row,
    with another content."""
    return batch.join(_new_keys(store, batch, order)[1], order, "left_semi")


def upsert(store: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """Insert-or-merge a batch into the store on ``content_hash``; urls are
    unique too.

    * batch rows whose hash exists in the store only extend that row's
      ``alt_sources`` (F12, in batch order); every other column keeps the
      stored (first) version;
    * a new hash whose url belongs to another content is refused (first wins;
      see ``upsert_rejects``) and adds nothing;
    * other new hashes are inserted once, first batch row wins, later copies of
      the same hash in the batch fold their alt_sources into it;
    * NULL hashes are distinct from each other, as in a SQL unique column: each
      such row is inserted unless its url is taken.  NULL and empty urls never
      conflict;
    * new rows get ids ``max(store id) + rank`` in ``order``.

    Both the store and the batch must carry ARTICLES_SCHEMA columns (the batch
    also ``order``, unique).  Per hash only the distinct additions (first
    occurrence order) are kept before folding, so a hot hash never gathers its
    rows.  Decisions and numbering run on narrow keys; whole rows move once.
    """
    new, refused = _new_keys(store, batch, order)
    adds = (batch.where(F.col("alt_sources").isNotNull() & (F.col("alt_sources") != ""))
            .select(order, "content_hash", "alt_sources").join(refused, order, "left_anti")
            .groupBy("content_hash", F.col("alt_sources").alias("add"))
            .agg(F.min(order).alias("_first")))
    adds_per_hash = adds.groupBy("content_hash").agg(
        F.sort_array(F.collect_list(F.struct("_first", "add"))).alias("_adds"))
    adds_per_hash = adds_per_hash.select("content_hash", F.transform("_adds", lambda x: x["add"]).alias("_adds"))

    existing = store.join(adds_per_hash, "content_hash", "left").withColumn(
        "alt_sources",
        F.when(F.col("_adds").isNull(), F.col("alt_sources"))
        .otherwise(fold_sources(F.col("alt_sources"), F.col("_adds")))).drop("_adds")

    fresh = batch.drop("id").join(numbered_insertions(new, store, order), order)
    # alt_sources of a fresh row: its own value folded with later copies'
    fresh = fresh.join(adds_per_hash, "content_hash", "left").withColumn(
        "alt_sources",
        F.when(F.col("_adds").isNull(), F.coalesce("alt_sources", F.lit("")))
        .otherwise(fold_sources(F.lit(""), F.col("_adds")))).drop("_adds")
    cols = [f.name for f in ARTICLES_SCHEMA.fields]
    return existing.select(*cols).unionByName(fresh.select(*cols))


def register_keywords(articles: DataFrame, text_col: str = "title",
                      stopwords=ENGLISH_STOPWORDS) -> tuple[DataFrame, DataFrame]:
    """Fill Keywords / Article_Keywords from article tokens.

    Keyword ids are dense in keyword order (``dense_ids`` over the distinct
    terms).  Returns ``(keywords, article_keywords)``.
    """
    pairs = spread(articles.select("id", text_col)).select(F.col("id").alias("article_id"),
                            F.explode(F.array_distinct(tokens(text_col))).alias("keyword"))
    stop = sorted(set(stopwords))
    if stop:  # top-level IN list -> hash-set lookup
        pairs = pairs.where(~F.col("keyword").isin(stop))
    pairs = pairs.distinct()
    kw = pairs.select("keyword").distinct()
    kw = dense_ids(kw, ["keyword"]).select("id", "keyword")
    bridge = pairs.join(kw, "keyword").select("article_id", F.col("id").alias("keyword_id"))
    return kw, bridge
def fold_alt_sources(df: DataFrame, key: str = "content_hash", source: str = "source",
                     order: str = "id") -> DataFrame:
    """F12 + J8 over groups of copies: per ``key`` the number of copies and the
    comma list of their sources in first-appearance order.

    Only distinct ``(key, source)`` pairs reach the per-key list, so a key with
    millions of copies still folds a list bounded by the number of sources.
    """
    firsts = df.groupBy(key, source).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
    lists = firsts.groupBy(key).agg(
        F.sum("_n").alias("copies"),
        F.sort_array(F.collect_list(F.struct("_first", source))).alias("_l"))
    return lists.select(key, "copies",
                        fold_sources(F.lit(""), F.transform("_l", lambda x: x[source])).alias("alt_sources"))
