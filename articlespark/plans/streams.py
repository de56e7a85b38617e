"""Registered streaming and export queries.

Streams read the driver's parquet tables as a file source (a table of one file
is picked out of its folder with ``pathGlobFilter``), run to completion with
``availableNow`` and write under the shared checkpoint folder; the query
returns the written result read back, so it must equal the batch SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_line
from ..session import scratch_path
from ..sources.sinks import EXPORT_COLUMNS, daily_report, export_json, read_report_detail
from ..sources.tables import EPOCH_2024, RAW_SCHEMA, articles_view, raw_batch_view, read_table
from ..sources.versions import ArticleStore
from ..streaming import ingest as st
from ..streaming.firstseen import first_seen
from .registry import (ARTICLES_CTE, EVENTS_CTE, FOLD_SQL, TOKEN_SQL, day_text, hash_sql, norm_sql, r6, register,
                       stop_sql, ts_text)


@register("stream_daily", "X1,X3,A4,S13", f"""
WITH {EVENTS_CTE.strip()}
SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, round(avg(score), 6) AS avg_score,
       count_if(score > 0.1) AS pos, count_if(score < -0.1) AS neg, count(score) AS total,
       round(count_if(score > 0.1) / count(score)::DOUBLE, 6) AS pos_ratio,
       round(count_if(score < -0.1) / count(score)::DOUBLE, 6) AS neg_ratio
FROM ev WHERE ts IS NOT NULL GROUP BY ts::DATE""")
def q_stream_daily(spark, sf_dir):
    out, ckpt = st.run_dir(spark, "stream_daily")
    events = st.table_stream(spark, sf_dir, "events", st.EVENTS_SCHEMA)
    scored = events.select("ts", ((F.col("value") - 50) / 100.0).alias("score"))
    st.stream_daily_sentiment(scored, out, ckpt)
    res = st.latest_windows(spark, out)
    return res.select(day_text("day").alias("day"), r6("avg_score").alias("avg_score"), "pos", "neg", "total",
                      r6("pos_ratio").alias("pos_ratio"), r6("neg_ratio").alias("neg_ratio"))


DOCS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


@register("stream_ingest", "X1,X2,D1,D4", f"""
SELECT doc_id AS seq, {hash_sql('text')} AS content_hash FROM documents
QUALIFY row_number() OVER (PARTITION BY {hash_sql('text')} ORDER BY doc_id) = 1""")
def q_stream_ingest(spark, sf_dir):
    store, ckpt = st.run_dir(spark, "stream_ingest")
    docs = st.table_stream(spark, sf_dir, "documents", DOCS_SCHEMA)
    raw = docs.select(
        F.col("doc_id").alias("seq"), first_line("text").alias("title"), F.col("text").alias("content"),
        "source", F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("doc_id") * 3600).alias("ingested_at"))
    st.stream_exact_ingest(raw, store, ckpt, horizon_days=100_000)
    return spark.read.parquet(store).select("seq", "content_hash")


SLICES = 4


def _arrivals(spark, sf_dir: str, name: str, run, late_every: int | None = None) -> None:
    """The documents as raw records that arrive in ``SLICES`` steps by doc_id; after each
    one ``run(folder, checkpoint)`` works the new files off, as a restarted query.  With
    ``late_every``, of the last 24 records of a step every so many come one step later."""
    raw = raw_batch_view(spark, sf_dir).withColumn("url", F.concat(F.lit("https://"), "source", F.lit(".example/"), "seq"))
    lo, hi = raw.agg(F.min("seq"), F.max("seq")).first()
    if lo is None:
        return
    span = hi - lo + 1
    step = F.floor((F.col("seq") - lo) * SLICES / F.lit(span)).cast("int")
    if late_every:
        last = F.ceil((step + 1) * F.lit(span) / SLICES) + lo - 1
        step = F.when((F.col("seq") % late_every == 0) & (F.col("seq") > last - 24), F.least(step + 1, F.lit(SLICES - 1))).otherwise(step)
    folder, checkpoint = st.run_dir(spark, name)
    for k in range(SLICES):
        raw.where(step == k).write.mode("append").parquet(folder)
        run(folder, checkpoint)


def _steps_sql(late_every: int | None = None) -> str:
    late = ("k" if not late_every else
            f"CASE WHEN doc_id % {late_every} = 0 AND doc_id > ceil((k + 1) * span / {SLICES}::DOUBLE) + lo - 1 - 24 THEN least(k + 1, {SLICES - 1}) ELSE k END")
    return f"""
d0 AS (SELECT *, min(doc_id) OVER () AS lo, max(doc_id) OVER () - min(doc_id) OVER () + 1 AS span FROM documents),
d1 AS (SELECT *, floor((doc_id - lo) * {SLICES} / span::DOUBLE)::INT AS k FROM d0),
steps AS (SELECT doc_id, text, source, {late} AS step FROM d1)"""


def _store_sql() -> str:
    """The steps one after the other: exact dedupe, TF-IDF of store and step, best match
    in the store, sources of matches, new rows by seq."""
    sql = f"""WITH {_steps_sql().strip()},
raw AS (SELECT doc_id AS seq, split_part(text, chr(10), 1) AS title, text AS content, source, step, {hash_sql('text')} AS h,
               {norm_sql('split_part(text, chr(10), 1)')} AS nt FROM steps),
d1t AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY step, nt ORDER BY seq) = 1),
b AS (SELECT * FROM d1t QUALIFY row_number() OVER (PARTITION BY step, h ORDER BY seq) = 1),
toks AS (SELECT seq, term, count(*) AS tf
         FROM (SELECT seq, unnest(regexp_extract_all(lower(title || ' ' || content), '{TOKEN_SQL}')) AS term FROM b)
         WHERE term NOT IN ({stop_sql()}) GROUP BY seq, term),
s0 AS (SELECT NULL::BIGINT AS id, NULL::BIGINT AS seq, NULL::VARCHAR AS h, NULL::VARCHAR AS alt WHERE false)"""
    for k in range(SLICES):
        sql += f""",
c{k} AS (SELECT seq, id, true AS stored FROM s{k} UNION ALL SELECT seq, NULL, false FROM b WHERE step = {k} AND content IS NOT NULL),
t{k} AS (SELECT toks.*, id, stored FROM toks JOIN c{k} USING (seq)),
f{k} AS (SELECT term, ln((1.0 + (SELECT count(*) FROM c{k})) / (1.0 + count(*))) + 1.0 AS idf FROM t{k} GROUP BY term),
r{k} AS (SELECT seq, id, stored, term, tf * idf AS x FROM t{k} JOIN f{k} USING (term)),
w{k} AS (SELECT seq, id, stored, term, x / sqrt(sum(x * x) OVER (PARTITION BY seq)) AS w FROM r{k}),
p{k} AS (SELECT l.seq, r.id, round(sum(l.w * r.w), 12) AS sim FROM w{k} l JOIN w{k} r ON l.term = r.term
         WHERE NOT l.stored AND r.stored GROUP BY l.seq, r.id),
m{k} AS (SELECT * FROM p{k} WHERE sim >= 0.85 QUALIFY row_number() OVER (PARTITION BY seq ORDER BY sim DESC, id) = 1),
a{k} AS (SELECT id, list(source ORDER BY first) AS l
         FROM (SELECT m.id, source, min(seq) AS first FROM m{k} m JOIN b USING (seq) GROUP BY m.id, source) GROUP BY id),
u{k} AS (SELECT s.id, s.seq, s.h, CASE WHEN l IS NULL THEN alt ELSE list_reduce(list_prepend(alt, l), {FOLD_SQL}) END AS alt
         FROM s{k} s LEFT JOIN a{k} USING (id)),
n{k} AS (SELECT (SELECT coalesce(max(id), 0) FROM s{k}) + row_number() OVER (ORDER BY seq) AS id, seq, h, '' AS alt
         FROM b WHERE step = {k} AND seq NOT IN (SELECT seq FROM m{k}) AND h NOT IN (SELECT h FROM s{k})),
s{k + 1} AS (SELECT * FROM u{k} UNION ALL SELECT * FROM n{k})"""
    return sql + f"""
SELECT s.id, raw.title, s.h AS content_hash, raw.source, s.alt AS alt_sources,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + s.seq * INTERVAL 1 HOUR, '%Y-%m-%d') AS day
FROM s{SLICES} s JOIN raw USING (seq)"""


@register("stream_store", "X1,X2,D3,D1,D2,D4,J6,J8,D13", _store_sql())
def q_stream_store(spark, sf_dir):
    """The documents through the whole ingest, in as many commits of a store as steps."""
    path = scratch_path(spark, "article_store")
    store = ArticleStore(spark, path)

    def run(folder, checkpoint):
        st.stream_into_store(st.file_stream(spark, folder, RAW_SCHEMA), path, checkpoint, horizon_hours=None)

    _arrivals(spark, sf_dir, "store-arrivals", run)
    return (store.articles().join(store.sources().select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id", "left")
            .select("id", "title", "content_hash", "source", "alt_sources", "day"))


@register("stream_first_seen", "X2,F4", f"""
WITH RECURSIVE {_steps_sql(17).strip()},
r AS (SELECT doc_id AS seq, doc_id * 3600000 AS ms, h, row_number() OVER (PARTITION BY h ORDER BY step, doc_id) AS n
      FROM (SELECT *, {hash_sql('text')} AS h FROM steps)),
f AS (
  SELECT h, n, seq, ms AS last, true AS kept FROM r WHERE n = 1
  UNION ALL
  SELECT r.h, r.n, r.seq, CASE WHEN abs(r.ms - f.last) >= 72 * 3600000 THEN greatest(r.ms, f.last) ELSE f.last END,
         abs(r.ms - f.last) >= 72 * 3600000
  FROM f JOIN r ON r.h = f.h AND r.n = f.n + 1)
SELECT seq, h AS content_hash FROM f WHERE kept""")
def q_stream_first_seen(spark, sf_dir):
    """Records that come late, copies over several micro-batches, and copies after the horizon."""
    out = scratch_path(spark, "first_seen")

    def run(folder, checkpoint):
        kept = first_seen(st.file_stream(spark, folder, RAW_SCHEMA), 72, "48 hours").select("seq", "content_hash")
        (kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())

    _arrivals(spark, sf_dir, "first-seen-arrivals", run, late_every=17)
    return spark.read.schema("seq long, content_hash string").parquet(out)


@register("snapshot_digest", "X4,A13", """
SELECT count(*) AS n_rows,
       CAST(coalesce(sum(('0x' || substr(sha256(concat_ws(chr(1), coalesce(CAST(doc_id AS VARCHAR), chr(2)),
                                                           coalesce(text, chr(2)))), 1, 15))::BIGINT), 0)
            AS VARCHAR) AS digest
FROM documents""")
def q_snapshot_digest(spark, sf_dir):
    return st.snapshot_digest(read_table(spark, sf_dir, "documents"), ["doc_id", "text"])


@register("report_detail_export", "S12,S9,D9,P11", f"""
WITH {ARTICLES_CTE.strip()}
SELECT title, source, category, sentiment_score, strftime(date, '%Y-%m-%d %H:%M:%S') AS date
FROM articles""")
def q_report_detail_export(spark, sf_dir):
    prefix = scratch_path(spark, "daily_report") + "/daily_report"
    daily_report(articles_view(spark, sf_dir), prefix, "2024-02-15")
    back = read_report_detail(spark, f"{prefix}_details_2024-02-15")
    return back.withColumn("date", ts_text("date"))


@register("articles_json_export", "S8,S11,F18", f"""
WITH {ARTICLES_CTE.strip()}
SELECT title, NULL::VARCHAR AS url, content, source, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, category,
       sentiment_score
FROM articles""")
def q_articles_json_export(spark, sf_dir):
    path = scratch_path(spark, "articles_json")
    arts = articles_view(spark, sf_dir).withColumn("url", F.lit(None).cast("string"))
    export_json(arts, path, EXPORT_COLUMNS)
    back = spark.read.schema(
        "title string, url string, content string, source string, date timestamp, category string, "
        "sentiment_score double").json(path)
    return back.withColumn("date", ts_text("date"))
