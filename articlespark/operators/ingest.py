"""Compound store operations: batch ingest (D3) and re-scoring.

Both return new versions of the store tables as DataFrames; the caller writes
them to fresh paths and switches its pointer (nothing is overwritten in place).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sentiment import score_lexicon
from ..functions.text import doc_text
from ..session import ensure_checkpoint_dir, spread, written
from ..sources.tables import ARTICLES_SCHEMA
from ..sources.versions import ArticleStore
from .dedupe import analysis_clean, exact_deduplicate, with_content_hash
from .feed import recent
from .fuzzy import fuzzy_deduplicate, source_updates, store_matches
from .store import enrich, get_or_create_sources, insertions, upsert, write_back_scores
from .tfidf import corpus_stats
from .vectors import one_text_an_id, term_lists, vectors_of


def ingest_batch(raw: DataFrame, articles: DataFrame, sources: DataFrame, now,
                 horizon_hours: float | None = 72, threshold: float = 0.85, cap: int | None = None):
    """D3: ``raw`` records (``seq, title, url, content, category, date,
    source, source_url``) into the store.

    hash (F4) -> exact dedupe in the batch (D1) -> fuzzy dedupe against the
    recent store (D2; matched rows only extend the store row's alt_sources) ->
    source dimension (J6) -> upsert on content_hash (D4).  Returns
    ``(articles, sources, matches)``.
    """
    batch = exact_deduplicate(with_content_hash(raw))
    store_view = enrich(articles, sources).join(articles.select("id", "alt_sources"), "id")
    survivors, updates, matches = fuzzy_deduplicate(
        batch, store_view, now=now, horizon_hours=horizon_hours, threshold=threshold, cap=cap)
    upd = updates.select("id", F.col("alt_sources").alias("_alt"))
    articles = (articles.join(upd, "id", "left")
                .withColumn("alt_sources", F.coalesce("_alt", "alt_sources")).drop("_alt"))
    sources = get_or_create_sources(survivors, sources)
    return upsert(articles.select(*ARTICLES_SCHEMA.names), _as_articles(survivors, sources), order="seq"), sources, matches


def _as_articles(survivors: DataFrame, sources: DataFrame) -> DataFrame:
    """Raw records as article rows without an id, in ARTICLES_SCHEMA and ``seq``."""
    sid = sources.select(F.col("name").alias("source"), F.col("id").alias("source_id"))
    rows = (survivors.join(sid, "source", "left")
            .withColumn("id", F.lit(None).cast("long"))
            .withColumn("alt_sources", F.lit(""))
            .withColumn("sentiment_score", F.lit(0.0)))  # F18 defaults at insert
    return rows.select(*[F.col(c).cast(ARTICLES_SCHEMA[c].dataType) for c in ARTICLES_SCHEMA.names], "seq")


@dataclass
class StoredCorpus:
    """What D2 needs of the store: the counts of its recent articles, (id, term, tf), how
    often terms occur in them, (term, df, corpus_tf), their number (a Column), and the
    counts as the store keeps them, (id, terms)."""
    counts: DataFrame
    stats: DataFrame
    documents: object
    lists: DataFrame


def _long(lists: DataFrame) -> DataFrame:
    """``(id, term, tf)`` of ``(id, terms)``."""
    return lists.select("id", F.explode("terms").alias("t")).select("id", "t.term", "t.tf")


def stored_corpus(store: ArticleStore, state: dict, now=None, horizon_hours: float | None = 72) -> StoredCorpus:
    """A10 without reading a text: the store's document frequencies by day are added
    up; only the day that the horizon cuts is counted again, from its term counts."""
    if horizon_hours is None:
        terms, days = store.terms(state), store.term_days(state)
    else:
        lo = F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(float(horizon_hours) * 3600))
        edge = store.spark.range(1).select(F.date_format(lo, "yyyy-MM-dd")).first()[0]
        terms = recent(store.terms(state, since=edge), now, horizon_hours)
        days = store.term_days(state, since=edge).where(F.col("day") > edge).drop("day")
        cut = _long(terms.where(F.col("day") == edge))
        days = days.unionByName(corpus_stats(cut)) \
            .unionByName(terms.where(F.col("day") == edge).agg(F.count(F.lit(1)).alias("df")), allowMissingColumns=True)
    stats = days.groupBy("term").agg(F.sum("df").alias("df"), F.sum("corpus_tf").alias("corpus_tf"))
    documents = stats.where("term IS NULL").select(F.coalesce(F.sum("df"), F.lit(0))).scalar()
    lists = terms.select("id", "terms")
    return StoredCorpus(_long(lists), stats.where("term IS NOT NULL"), documents, lists)


def ingest_into(store: ArticleStore, raw: DataFrame, now=None, horizon_hours: float | None = 72, threshold: float = 0.85,
                cap: int | None = None, feed: str | None = None, batch_id: int = 0) -> bool:
    """D3 as one commit of ``store``: the rows that ``ingest_batch`` would give, without
    rewriting days that the batch does not touch and without tokenising stored texts
    again.  A batch that its feed has committed already changes nothing (returns False).
    ``now=None``: the newest ``ingested_at`` of the batch."""
    ensure_checkpoint_dir(store.spark)
    state = store.state()
    if feed is not None and store.is_done(feed, batch_id, state):
        return False
    raw = written(raw, "raw")
    if now is None and horizon_hours is not None and "ingested_at" in raw.columns:
        now = raw.agg(F.max("ingested_at")).first()[0]
    batch = written(exact_deduplicate(with_content_hash(raw)), "batch")
    articles, sources = store.articles(state), store.sources(state)
    # The batch's own counts, as the store keeps them.
    texts = batch.select((-F.col("seq") - 1).alias("id"), doc_text("title", "content").alias("_text")).where("_text IS NOT NULL")
    lists = written(term_lists(spread(one_text_an_id(texts)), "id", "_text"), "terms")
    if state["terms"]:
        known = stored_corpus(store, state, now, horizon_hours)
        stats = known.stats.unionByName(corpus_stats(_long(lists))).groupBy("term") \
            .agg(F.sum("df").alias("df"), F.sum("corpus_tf").alias("corpus_tf"))
        documents = known.documents + texts.select(F.count(F.lit(1))).scalar()
        vectors = vectors_of(known.lists.unionByName(lists).select("id", "terms.term", "terms.tf"), documents, cap, stats=stats)
        matches = store_matches(vectors, threshold).checkpoint()
    else:  # nothing stored that a row could be like
        matches = batch.select("seq", F.lit(0).cast("long").alias("store_id"), F.lit(0.0).alias("sim")).limit(0)
    survivors = batch.join(matches.select("seq"), "seq", "left_anti")
    sources = get_or_create_sources(survivors, sources).checkpoint()
    inserted = written(insertions(articles, _as_articles(survivors, sources)), "inserted")
    # Articles of an unknown source are no candidates of later batches (J1's inner join).
    keys = inserted.where("source_id IS NOT NULL").select((-F.col("seq") - 1).alias("_key"), "id", "date")
    keys = keys.join(texts.select(F.col("id").alias("_key")), "_key")
    terms = written(keys.join(lists.withColumnRenamed("id", "_key"), "_key").select("id", "date", "terms"), "terms")
    updates = source_updates(batch, matches, articles).checkpoint()
    store.commit(state, inserted, updates, sources, terms, feed, batch_id)
    return True


def rescore(articles: DataFrame, lexicon: DataFrame, text_col: str = "content") -> DataFrame:
    """Score every article (G1) and write the scores back by id."""
    scores = score_lexicon(articles.select("id", text_col), lexicon, text_col, "id", "score")
    return write_back_scores(articles, scores.select("id", "score"))


def rescore_survivors(articles: DataFrame, lexicon: DataFrame, text_col: str = "content") -> DataFrame:
    """D7, phase 2: only the rows that the analysis cleaning (D6) keeps are scored and
    written back.  Over articles bucketed by id the write-back moves the scores alone."""
    scores = score_lexicon(analysis_clean(articles).select("id", text_col), lexicon, text_col, "id", "score")
    return write_back_scores(articles, scores.select("id", "score"))
