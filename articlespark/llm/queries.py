"""The queries ``opN_<name>``: each applies one operator of this subpackage to its
whole table and derives the columns of its contract from the operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Query
from ..sources.tables import read_table

QUERIES: dict[str, Query] = {}


def _register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = Query(name, fn, sql.strip() if sql else None, "llm")
        return fn
    return deco


@_register("op1_decontaminate")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "spans")


@_register("op10_warc", """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (
  SELECT page_id, octet_length(payload) AS n, sha1(payload) AS sha,
         min(page_id) OVER (PARTITION BY payload) AS first FROM p),
b AS (  -- base 32: ten hexadecimal digits are eight letters of five bits
  SELECT *, list_aggregate([
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + ((('0x' || substr(sha, 1 + 10 * (k // 8), 10))::BIGINT >> (35 - 5 * (k % 8))) & 31)::INT, 1)
           FOR k IN range(32)], 'string_agg', '') AS digest FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b""")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_and_index

    return archive_and_index(read_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_register("op6_mix")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import row_ids
    from .mixing import mix

    docs = row_ids(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "rid")
    return mix(docs, "rid").select("doc_id", "size", "source_size", "target", "taken")


@_register("op5_token_count")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokencount import count_tokens

    counted = count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@_register("op2_language_id")
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identify, learn_from_documents

    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, learn_from_documents(docs), ["doc_id"]).select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "mixture")


@_register("op7_html_text")
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract_main_text

    return extract_main_text(read_table(spark, sf_dir, "pages")) \
        .withColumn("n_chars", F.char_length("text").cast("bigint"))


@_register("op3_topk", """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS uid,
         [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT a.uid, a.vec_id AS query_id, b.vec_id,
         list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)])::BIGINT AS score, b.uid AS cuid
  FROM v a JOIN v b ON a.uid <> b.uid AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id, cuid) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5""")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_register("op4_line_dedup", """
WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS rid FROM documents),
l AS (
  SELECT rid, unnest(range(len(string_split(text, chr(10))))) AS line_no,
         unnest(string_split(text, chr(10))) AS line FROM d),
w AS (
  SELECT rid, line_no, regexp_extract_all(lower(line), '[^\\x20\\x09-\\x0D]+') AS w FROM l),
p AS (SELECT *, len(w) AS n, rid * 1000000 + line_no AS place FROM w WHERE len(w) >= 4),
u AS (SELECT w, min(n) AS n, min(place) AS place FROM p GROUP BY w),
v AS (
  SELECT w, n, place, i, w[1:i - 1] || w[i + 1:] AS r
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM u WHERE n >= 10)),
near AS (
  SELECT w FROM (SELECT w, place, min(place) OVER (PARTITION BY n, i, r) AS e FROM v) WHERE e < place
  UNION SELECT v.w FROM v JOIN u ON v.r = u.w AND u.n >= 10 WHERE u.place < v.place
  UNION SELECT u.w FROM v JOIN u ON v.r = u.w AND u.n >= 10 WHERE v.place < u.place),
gone AS (
  SELECT p.rid, p.line_no FROM p JOIN u USING (w)
  WHERE p.place <> u.place OR p.w IN (SELECT w FROM near)),
k AS (
  SELECT l.rid, count(*)::BIGINT AS n_lines, count(gone.line_no)::BIGINT AS n_dropped,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (gone.line_no IS NULL), '') AS text
  FROM l LEFT JOIN gone ON l.rid = gone.rid AND l.line_no = gone.line_no GROUP BY l.rid)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped,
       CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text
FROM d LEFT JOIN k USING (rid)""")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import drop_repeated_lines

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("bigint")
    docs = drop_repeated_lines(docs.withColumn("n_lines", lines))
    return docs.select("doc_id", "n_lines", F.size("dropped_lines").cast("bigint").alias("n_dropped"), "text")


@_register("op8_ngram_join", """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([w[i:i + 4] FOR i IN range(1, len(w) - 3)])
                      WHEN len(w) >= 1 THEN [w] ELSE [] END AS s FROM w),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM o JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y
  WHERE 100 * n >= 75 * (len(a.s) + len(b.s) - n)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.c AS component_id
FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)""")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import row_ids
    from .ngramjoin import link_documents

    docs = row_ids(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "rid")
    return link_documents(docs, "rid").select("doc_id", "n_shingles", "component_id")


@_register("op9_lm_score")
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import row_ids
    from .ctxmix import score_documents

    docs = row_ids(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "rid")
    return score_documents(docs, "rid").drop("rid")


@_register("op11_embedding_dups", """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([1 FOR x IN embedding IF x <> 0]) > 0),
u AS (SELECT vec_id, label, e, sqrt(list_sum([x * x FOR x IN e])) AS norm FROM v),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y
  FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_sum([a.e[i] * b.e[i] FOR i IN range(1, len(a.e) + 1)]) / (a.norm * b.norm) >= 0.93),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.vec_id),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id) LEFT JOIN n ON x = vec_id""")
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import link_vectors

    return link_vectors(read_table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


@_register("op12_whitening")
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(read_table(spark, sf_dir, "embeddings"))


def _cluster_sql(rounds: int = 3) -> str:
    sql = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64
    AND len([1 FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q
  FROM (SELECT sha256('1:' || vec_id) AS h, q FROM v WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT 16))"""
    for k in range(rounds + 1):
        sql += f""",
a{k} AS (
  SELECT rid, vec_id, q, c, d
  FROM (SELECT v.rid, v.vec_id, v.q, c.c,
               list_sum([(v.q[i] - c.q[i]) * (v.q[i] - c.q[i]) FOR i IN range(1, 65)])::BIGINT AS d
        FROM v, c{k} c)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"""
        if k < rounds:
            sql += f""",
m{k} AS (
  SELECT c, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY i) AS q
  FROM (SELECT c, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{k}, range(1, 65) r(i) GROUP BY c, i) GROUP BY c),
c{k + 1} AS (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{k} c LEFT JOIN m{k} m USING (c))"""
    return sql + f"""
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(e.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} e USING (c)"""


@_register("op13_centroid_clusters", _cluster_sql())
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .zonecluster import cluster

    return cluster(read_table(spark, sf_dir, "embeddings"))
