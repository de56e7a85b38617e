"""Registered queries over written stores: articles by day (P9, D12), scores written back
to bucketed articles (J7, D7), changes between snapshots (X4)."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..functions.sentiment import lexicon_from_labels
from ..functions.stopwords import ENGLISH_STOPWORDS
from ..operators.feed import date_range
from ..operators.ingest import rescore_survivors
from ..operators.simjoin import FEW_IDS
from ..operators.store import get_or_create_sources
from ..operators.vectors import one_text_an_id, term_lists
from ..session import ensure_checkpoint_dir, scratch_path, spread
from ..sources.tables import ARTICLES_SCHEMA, articles_view, bucket_count, raw_batch_view, read_table, write_bucketed
from ..sources.versions import ArticleStore
from ..streaming import ingest as st
from .cleaning import NOW
from .registry import ARTICLES_CTE, TOKEN_SQL, r6, register, ts_text


def _day_store(spark, sf_dir) -> ArticleStore:
    """All documents as one commit of an article store."""
    ensure_checkpoint_dir(spark)
    store = ArticleStore(spark, scratch_path(spark, "day_store"))
    raw = raw_batch_view(spark, sf_dir)
    sources = get_or_create_sources(raw).checkpoint()
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    # Read from the documents each time: a copy of the texts would be as large as the store.
    rows = (articles_view(spark, sf_dir).join(F.broadcast(names) if names.count() <= FEW_IDS else names, "source", "left")
            .withColumn("url", F.lit(None).cast("string")).withColumn("content_hash", F.lit("")).withColumn("alt_sources", F.lit("")))
    rows = rows.select(*(F.col(c).cast(ARTICLES_SCHEMA[c].dataType) for c in ARTICLES_SCHEMA.names))
    store.commit(store.state(), rows, rows.select("id", "alt_sources").limit(0), sources, _day_terms)
    return store


def _day_terms(rows):
    """``(id, date, terms)`` of the articles that have a term, where they are stored.  What the texts of
    an id hold counts for each of its rows."""
    rows = rows.where("id IS NOT NULL")
    texts = rows.where("content IS NOT NULL")
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        lists = term_lists(spread(texts.select(F.struct("id", "date").alias("id"), "content")), "id", "content", ENGLISH_STOPWORDS)
        return lists.where(F.size("terms") > 0).select("id.id", "id.date", "terms")
    lists = term_lists(one_text_an_id(texts.select("id", F.col("content").alias("_text"))), "id", "_text", ENGLISH_STOPWORDS)
    return rows.select("id", "date", "day").join(lists.where(F.size("terms") > 0), "id").hint("rebalance", "day").drop("day")


@register("store_date_range", "P9,P4,D4", f"""
WITH {ARTICLES_CTE.strip()}
SELECT id, title, strftime(date, '%Y-%m-%d %H:%M:%S') AS date FROM articles
WHERE CAST(date AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""")
def q_store_date_range(spark, sf_dir):
    """A date range of the store by day: only the folders of its days are opened."""
    store = _day_store(spark, sf_dir)
    found = date_range(store.articles(since="2024-01-10", until="2024-01-20").where("day BETWEEN '2024-01-10' AND '2024-01-20'"),
                       "2024-01-10", "2024-01-20")
    return found.select("id", "title", ts_text("date").alias("date"))


@register("store_purge", "D12,A10", f"""
WITH {ARTICLES_CTE.strip()},
kept AS (SELECT *, strftime(date, '%Y-%m-%d') AS day FROM articles
         WHERE date IS NULL OR CAST(date AS DATE) >= DATE '{NOW[:10]}' - 30)
SELECT k.day, k.articles, t.terms
FROM (SELECT day, count(*) AS articles FROM kept GROUP BY day) k
JOIN (SELECT day, sum(n)::BIGINT AS terms
      FROM (SELECT day, len(list_distinct([x FOR x IN regexp_extract_all(lower(content), '{TOKEN_SQL}')
                                           IF x NOT IN ({', '.join("'" + w.replace("'", "''") + "'" for w in sorted(ENGLISH_STOPWORDS))})])) AS n FROM kept)
      GROUP BY day) t USING (day)""")
def q_store_purge(spark, sf_dir):
    """Days before the cutoff leave by a commit record; what is left of articles and of the
    stored document frequencies, by day."""
    store = _day_store(spark, sf_dir)
    store.purge(datetime.fromisoformat(NOW), 30)
    articles = store.articles().groupBy("day").agg(F.count(F.lit(1)).alias("articles"))
    terms = store.term_days().where("term IS NOT NULL").groupBy("day").agg(F.sum("df").alias("terms"))
    return articles.join(terms, "day").select("day", "articles", "terms")


LABEL = "(quality - toxic)"
LEXICON_SQL = f"""
lab AS (SELECT doc_id AS id, text AS content, {LABEL}::DOUBLE AS label FROM documents JOIN labels USING (doc_id) WHERE {LABEL} IS NOT NULL),
lt AS (SELECT label, unnest(list_distinct(regexp_extract_all(lower(coalesce(content, '')), '{TOKEN_SQL}'))) AS term FROM lab),
lexicon AS (SELECT term, avg(label) - (SELECT avg(label) FROM lab) AS polarity, count(*) AS n FROM lt GROUP BY term HAVING count(*) >= 5)"""


def _lexicon(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") - F.col("toxic")).cast("double").alias("label"))
    return lexicon_from_labels(docs, labels)


@register("learned_lexicon", "G1,A17,F5", f"""
WITH {LEXICON_SQL.strip()}
SELECT term, round(polarity, 6) AS polarity, n FROM lexicon""")
def q_learned_lexicon(spark, sf_dir):
    return _lexicon(spark, sf_dir).select("term", r6("polarity").alias("polarity"), "n")


@register("rescore_survivors", "D7,D6,J7,G1,F5", f"""
WITH {ARTICLES_CTE.strip()}, {LEXICON_SQL.strip()},
clean AS (SELECT * FROM articles WHERE title IS NOT NULL AND content IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY title, source ORDER BY id) = 1),
ct AS (SELECT id, unnest(regexp_extract_all(lower(content), '{TOKEN_SQL}')) AS term FROM clean),
scored AS (SELECT id, avg(polarity) AS p FROM ct JOIN lexicon USING (term) GROUP BY id)
SELECT a.id, round(CASE WHEN c.id IS NULL THEN a.sentiment_score ELSE greatest(-1, least(1, coalesce(s.p, 0))) END, 6) AS sentiment_score
FROM articles a LEFT JOIN clean c ON c.id = a.id LEFT JOIN scored s ON s.id = a.id""")
def q_rescore_survivors(spark, sf_dir):
    """Articles bucketed by id, scored from a lexicon table; rows that the cleaning drops keep their score."""
    name = f"articles_{uuid.uuid4().hex[:12]}"
    view = articles_view(spark, sf_dir)
    # Dealt by bucket, so that a bucket is one file of one task.
    buckets = bucket_count(view)
    articles = write_bucketed(view.repartition(buckets, "id"), name, "id", buckets, scratch_path(spark, name))
    lexicon = _lexicon(spark, sf_dir).checkpoint()
    return rescore_survivors(articles, lexicon).select("id", r6("sentiment_score").alias("sentiment_score"))


@register("snapshot_changes", "X4", """
WITH old AS (SELECT doc_id, text, source FROM documents),
new AS (
  SELECT doc_id, CASE WHEN doc_id % 128 = 3 THEN coalesce(text, '') || ' changed' ELSE text END AS text, source
  FROM documents WHERE doc_id % 128 <> 5
  UNION ALL SELECT doc_id + 1000000000, text, 'new' FROM documents WHERE doc_id % 128 = 9)
SELECT CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' ELSE 'update' END AS change,
       coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN o.text ELSE n.text END AS text,
       coalesce(n.source, o.source) AS source
FROM old o FULL JOIN new n ON o.doc_id = n.doc_id
WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR n.text IS DISTINCT FROM o.text""")
def q_snapshot_changes(spark, sf_dir):
    """Two snapshots of the documents in ranges of 16 ids; inserts, updates and deletes."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    left = F.col("doc_id") % 128
    new = docs.where(left != 5).withColumn("text", F.when(left == 3, F.concat(F.coalesce("text", F.lit("")), F.lit(" changed"))).otherwise(F.col("text")))
    new = new.unionByName(docs.where(left == 9).select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "text", F.lit("new").alias("source")))
    base = scratch_path(spark, "snapshots")
    part = F.floor(F.col("doc_id") / 16)
    st.write_snapshot(docs, f"{base}/old", part)
    st.write_snapshot(new, f"{base}/new", part)
    return st.change_feed(spark, f"{base}/old", f"{base}/new", ["doc_id"])
