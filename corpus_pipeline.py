"""A pipeline over ``documents`` made of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next stage's ``docs``.  All but the last return the columns they got.

* language_id drops documents without an identifiable language (null texts, texts
  without letters) and fills in a missing ``lang``.
* line_dedup cuts lines that an earlier document has (equal, or one word apart), and
  drops documents of which nothing is left.
* near_duplicates keeps one document of each group of linked ones: the smallest doc_id
  (null last), of equal ids the first row.
* decontamination drops documents that hold a passage of the benchmark.
* mixing returns the documents of the mix with mix_copies, mix_size and mix_target.

Null, empty and very long texts, ties, repeated rows, empty tables and further columns
(of any name) are handled as the operators' docstrings say; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articlespark.llm.common import fresh, row_ids, written
from articlespark.llm.decontaminate import find_contamination
from articlespark.llm.langid import UNKNOWN, identify, learn_from_documents
from articlespark.llm.linededup import drop_repeated_lines
from articlespark.llm.mixing import WORD, mix_documents
from articlespark.llm.ngramjoin import link_documents
from articlespark.sources.tables import read_table


def _with_n_chars(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text, where the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = identify(docs, learn_from_documents(docs), docs.columns).where(F.col("lang_pred") != UNKNOWN)
    kept = found.select("row.*", F.col("lang_pred").alias(fresh(docs, "lang_pred")))
    return kept.withColumn("lang", F.coalesce("lang", kept.columns[-1])).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = drop_repeated_lines(docs)
    lost = cut.columns[-1]
    return _with_n_chars(cut.where((F.size(lost) == 0) | F.col("text").rlike(WORD)).select(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rid = fresh(docs, "row")
    numbered = row_ids(docs, rid)
    linked = link_documents(numbered.select(rid, "doc_id", "text"), rid)
    gone = linked.where(F.col("keeper") != F.col(rid)).select(rid)
    return numbered.join(gone, rid, "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = find_contamination(whole, read_table(spark, sf_dir, "benchmark"), carry=("row",))
    return found.where("n_hit = 0").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("mixing", mixing)]

#: Mixture inference by expectation-maximisation is beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
