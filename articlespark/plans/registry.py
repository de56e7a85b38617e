"""Registry of named queries: a Spark builder and (when SQL can express it)
the equivalent DuckDB SQL over the same parquet tables.

Conventions shared by both sides so results compare value for value:
timestamps are rendered as ``yyyy-MM-dd HH:mm:ss`` text, days as
``yyyy-MM-dd`` text, doubles are rounded to 6 places, every computed column is
aliased to the same name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    ops: str


REGISTRY: dict[str, Query] = {}


def register(name: str, ops: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql.strip() if sql else None, ops)
        return fn
    return deco


def ts_text(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def day_text(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd")


def r6(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6)


# SQL twin of sources.tables.articles_view / raw_batch_view / events_view.
ARTICLES_CTE = """
articles AS (
  SELECT doc_id AS id,
         split_part(text, chr(10), 1) AS title,
         text AS content,
         source,
         TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 HOUR AS date,
         lang AS category,
         ((doc_id * 37) % 201 - 100) / 100.0::DOUBLE AS sentiment_score
  FROM documents)"""

SOURCES_CTE = """
sources AS (
  SELECT row_number() OVER (ORDER BY source) AS id, source AS name,
         'https://' || source || '.example' AS url
  FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))"""

EVENTS_CTE = """
ev AS (
  SELECT event_id, ts, event_type AS source, (value - 50) / 100.0::DOUBLE AS score
  FROM events)"""


def load_all() -> dict[str, Query]:
    """Import the query modules (they register themselves) and return them."""
    from . import analytics, cleaning, exports, ingest, similarity, stores, streams, textual  # noqa: F401

    return REGISTRY


# SQL twins of the text functions (same regular expressions).
def _ws() -> str:
    from ..functions.text import WS

    return WS


def clean_sql(expr: str) -> str:
    return f"trim(regexp_replace(coalesce({expr}, ''), '{_ws()}+', ' ', 'g'))"


def norm_sql(expr: str) -> str:
    return (f"lower(trim(regexp_replace(regexp_replace(coalesce({expr}, ''), '<[^>]+>', '', 'g'), "
            f"'{_ws()}+', ' ', 'g')))")


def hash_sql(expr: str) -> str:
    n = norm_sql(expr)
    return f"(CASE WHEN {n} = '' THEN '' ELSE sha256({n}) END)"


FOLD_SQL = ("lambda acc, x: CASE WHEN x IS NULL THEN acc WHEN acc IS NULL OR acc = '' THEN x "
            "WHEN instr(acc, x) > 0 THEN acc ELSE acc || ',' || x END")


def stop_sql() -> str:
    from ..functions.stopwords import ENGLISH_STOPWORDS

    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(ENGLISH_STOPWORDS))


TOKEN_SQL = r"[\p{L}\p{N}_]{2,}"
