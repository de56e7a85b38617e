"""Term counts of a new store: made from the stored articles, written once; small beside checkpoints of texts."""

import random
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from articlespark.operators.tfidf import term_counts
from articlespark.operators.vectors import term_lists
from articlespark.plans import stores
from articlespark.session import ensure_checkpoint_dir
from articlespark.sources.versions import _day_counts
from frames import rows


def test_lists_hold_the_counts(spark):
    docs = spark.createDataFrame([(1, "river Stone stone the"), (2, None), (3, "of the"), (4, "ébène zebra élan stone")], "id long, content string")
    lists = term_lists(docs).checkpoint()
    assert rows(lists.select("id", F.explode("terms").alias("t")).select("id", "t.term", "t.tf")) == rows(term_counts(docs))
    assert lists.count() == 4 and lists.where("terms <> array_sort(terms)").count() == 0


def test_day_terms_of_rows_that_share_an_id(spark):
    at = datetime(2024, 1, 1)
    data = [(1, "stone bridge", at, "2024-01-01"), (1, "stone", at + timedelta(1), "2024-01-02"), (2, "the", at, "2024-01-01"), (None, "coast", at, "2024-01-01")]
    for k, want in ((4, [("2024-01-01", 2, 3), ("2024-01-02", 2, 3)]), (1, [("2024-01-01", 2, 2)])):
        held = spark.createDataFrame(data[:k], "id long, content string, date timestamp, day string")
        got = stores._day_terms(held).select(F.date_format("date", "yyyy-MM-dd"), F.size("terms"), F.expr("aggregate(terms, 0L, (a, t) -> a + t.tf)"))
        assert sorted(map(tuple, got.collect())) == want


def test_day_counts_of_a_batch(spark):
    data = [("a", [("x", 2), ("y", 1)], "f"), ("b", [("x", 1)], "f"), ("a", [("x", 3)], "f"), ("c", [], "g")]
    df = spark.createDataFrame(data, "day string, terms array<struct<term:string,tf:bigint>>, folder string").coalesce(1)
    out = df.mapInArrow(_day_counts, "folder string, day string, term string, df bigint, corpus_tf bigint")
    got = sorted(map(tuple, out.groupBy("folder", "day", "term").agg(F.sum("df"), F.sum("corpus_tf")).collect()), key=str)
    assert got == sorted([("f", "a", "x", 2, 5), ("f", "a", "y", 1, 1), ("f", "a", None, 2, None), ("f", "b", "x", 1, 1), ("f", "b", None, 1, None),
                          ("g", "c", None, 1, None)], key=str)


def test_day_store_writes_no_copy_of_the_texts(spark, tmp_path):
    rnd = random.Random(4)
    docs = [(i, " ".join(f"word{rnd.randrange(2000)}" for _ in range(400)), "en", f"s{i % 5}", 1) for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    store = stores._day_store(spark, str(tmp_path))
    assert store.articles().count() == store.terms().count() == 300
    assert size() - before < 3 * sum(len(d[1]) for d in docs)
