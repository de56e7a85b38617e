"""Exact deduplication (W1, D1, D6) and the analysis cleaning chain.

Keep-first per key is an aggregate, not a window: ``min_by(struct(row), seq)``
is combined map-side, so a key holding a third of all rows shrinks to one row
per input partition before the shuffle instead of landing in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, normalize_text


def keep_first(df: DataFrame, keys: Sequence[str], order: str = "seq",
               null_keys: str = "group") -> DataFrame:
    """Per distinct ``keys`` keep the row with the smallest ``order``.

    ``null_keys="group"`` treats NULL keys as equal (pandas ``drop_duplicates``
    does); ``"distinct"`` keeps every row whose key has a NULL.
    ``order`` must be unique for a deterministic result.
    """
    cols = df.columns
    keys = list(keys)
    if null_keys == "distinct":
        has_null = F.lit(False)
        for k in keys:
            has_null = has_null | F.col(k).isNull()
        passthrough = df.where(has_null)
        df = df.where(~has_null)
    best = (df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
            .agg(F.min_by(F.struct(*cols), F.col(order)).alias("_row"))
            .select("_row.*"))
    if null_keys == "distinct":
        best = best.unionByName(passthrough)
    return best


def exact_deduplicate(df: DataFrame, order: str = "seq", null_keys: str = "group") -> DataFrame:
    """Three sequential keep-first passes -- url, normalised title,
    content_hash; each pass only sees the survivors of the previous one.  The
    url / hash passes are skipped when the column is absent.

    The passes run on a narrow projection (order key + the three keys); the
    surviving full rows are fetched with one semi-join on the (unique) order
    key, so wide columns such as the article text shuffle once, not per pass.
    """
    keys = [c for c in ("url", "content_hash") if c in df.columns]
    narrow = df.select(order, *keys, normalize_text("title").alias("_norm_title"))
    if "url" in keys:
        narrow = keep_first(narrow, ["url"], order, null_keys)
    narrow = keep_first(narrow, ["_norm_title"], order, null_keys)
    if "content_hash" in keys:
        narrow = keep_first(narrow, ["content_hash"], order, null_keys)
    return df.join(narrow.select(order), order, "left_semi")


def with_content_hash(df: DataFrame, content: str = "content") -> DataFrame:
    """F4 applied to a batch: ``content_hash`` of the normalised content."""
    return df.withColumn("content_hash", content_hash(content))


def analysis_clean(df: DataFrame, order: str = "id") -> DataFrame:
    """Drop rows without title/content (P2), keep first per (title, source),
    missing category -> 'Unknown' (P3), dates parsed leniently (F7)."""
    out = df.dropna(subset=["title", "content"])
    out = keep_first(out, ["title", "source"], order)
    out = out.fillna({"category": "Unknown"})
    if dict(out.dtypes).get("date") == "string":
        out = out.withColumn("date", F.try_to_timestamp(F.col("date")))
    return out
