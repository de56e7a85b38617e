"""Sentiment labels (F6) and scorers.

Labels are column expressions.  The default scorer is a lexicon *table*
``(term, polarity[, lang])`` joined to the exploded tokens: a JVM-side equi-join
(AQE broadcasts the lexicon after measuring it) and a per-document average that
is combined map-side.  A model scorer can be plugged in as an Arrow-batched
pandas UDF instead; it never sees NULL/empty texts (they score 0.0).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread
from .text import tokens

POLICIES = {
    # name: (threshold, null handling)
    "classify": (0.1, "neutral"),   # anything not > t / < -t is neutral, NULL too
    "bucket": (0.1, "none"),        # explicit -t <= s <= t; NULL is in no bucket
    "cards": (0.2, "zero"),         # browser cards: NULL counts as 0
}


def sentiment_label(score: str | Column, threshold: float = 0.1, nulls: str = "neutral") -> Column:
    """'positive' / 'negative' / 'neutral' with a named NULL policy."""
    s = F.col(score) if isinstance(score, str) else score
    if nulls == "zero":
        s = F.coalesce(s, F.lit(0.0))
    lab = (F.when(s > threshold, "positive").when(s < -threshold, "negative"))
    if nulls == "none":
        return lab.when((s >= -threshold) & (s <= threshold), "neutral")
    return lab.otherwise("neutral")


def policy_label(score: str | Column, policy: str) -> Column:
    t, nulls = POLICIES[policy]
    return sentiment_label(score, t, nulls)


# Our own small English polarity lexicon (term, polarity in [-1, 1]).
DEFAULT_LEXICON = [
    ("good", 0.7), ("great", 0.8), ("excellent", 1.0), ("best", 1.0), ("better", 0.5),
    ("positive", 0.2), ("happy", 0.8), ("success", 0.6), ("win", 0.8), ("wins", 0.8),
    ("gain", 0.4), ("gains", 0.4), ("growth", 0.3), ("strong", 0.4), ("improve", 0.4),
    ("improved", 0.4), ("hope", 0.3), ("safe", 0.5), ("love", 0.5), ("new", 0.14),
    ("bad", -0.7), ("worse", -0.4), ("worst", -1.0), ("poor", -0.4), ("negative", -0.3),
    ("sad", -0.5), ("fail", -0.5), ("failed", -0.5), ("failure", -0.3), ("loss", -0.4),
    ("losses", -0.4), ("crash", -0.6), ("crisis", -0.5), ("weak", -0.4), ("war", -0.6),
    ("attack", -0.5), ("death", -0.6), ("dead", -0.6), ("fear", -0.5), ("risk", -0.2),
]

LEXICON_SCHEMA = T.StructType([
    T.StructField("term", T.StringType(), False),
    T.StructField("polarity", T.DoubleType(), False),
])


def lexicon_frame(spark: SparkSession, entries=None) -> DataFrame:
    return spark.createDataFrame(list(entries or DEFAULT_LEXICON), LEXICON_SCHEMA)


def lexicon_from_labels(docs: DataFrame, labels: DataFrame, min_docs: int = 5, id_col: str = "id",
                        text_col: str = "content", label: str = "label") -> DataFrame:
    """A lexicon learned from scored documents: a term's polarity is the mean label (-1 to 1)
    of the documents that hold it, less the mean of all, for terms of at least
    ``min_docs`` of them.  Counted map-side: a frequent term costs a row a task."""
    known = docs.join(labels.select(id_col, label).where(F.col(label).isNotNull()), id_col)
    base = known.select(F.avg(label)).scalar()
    terms = known.select(label, F.explode(F.array_distinct(tokens(text_col))).alias("term"))
    means = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("mean"))
    return means.where(F.col("n") >= min_docs).select("term", (F.col("mean") - base).alias("polarity"), "n")


def score_lexicon(df: DataFrame, lexicon: DataFrame, text_col: str = "content",
                  id_col: str = "id", out_col: str = "sentiment_score",
                  lang_col: str | None = None) -> DataFrame:
    """Mean polarity of the lexicon terms found in each text (every
    occurrence counts), clamped to [-1, 1]; no match / NULL / '' -> 0.0.

    With ``lang_col`` and a lexicon that has a ``lang`` column, a term only
    matches texts of its language (the language guard).
    """
    cols = [id_col, F.explode(tokens(text_col)).alias("term")]
    if lang_col:
        cols.insert(1, F.col(lang_col).alias("lang"))
    toks = spread(df).select(*cols)
    keys = ["term", "lang"] if (lang_col and "lang" in lexicon.columns) else ["term"]
    lex = lexicon.select(*keys, "polarity")
    per_doc = (toks.join(lex, keys)
               .groupBy(id_col).agg(F.avg("polarity").alias("_pol")))
    return (df.join(per_doc, id_col, "left")
            # coalesce first: greatest/least skip NULLs
            .withColumn(out_col, F.least(F.greatest(F.coalesce(F.col("_pol"), F.lit(0.0)), F.lit(-1.0)),
                                         F.lit(1.0)))
            .drop("_pol"))


def score_with(df: DataFrame, scorer: Callable, text_col: str = "content",
               out_col: str = "sentiment_score") -> DataFrame:
    """F5 with a plug-in scorer: ``scorer`` is a pandas UDF ``Series -> Series``
    (Arrow batches; use an iterator UDF to load a model once per task).
    NULL / empty texts score 0.0 without calling it; a NULL result -> 0.0."""
    t = F.col(text_col)
    empty = t.isNull() | (t == "")
    # Python UDFs run before any CASE around them, so split the rows instead.
    scored = df.where(~empty).withColumn(out_col, F.coalesce(scorer(t), F.lit(0.0)))
    return scored.unionByName(df.where(empty).withColumn(out_col, F.lit(0.0)))
