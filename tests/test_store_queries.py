"""Box plots from one pass, bucketed write-back, change feeds, pruned matches, shrinking rounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from articlespark.operators import simjoin
from articlespark.operators.boxplot import box_statistics
from articlespark.operators.fuzzy import corpus_vectors
from articlespark.operators.greedy import resolve
from articlespark.operators.store import write_back_scores
from articlespark.sources.extract import PAGE_RULE, extract_articles
from articlespark.sources.tables import RAW_SCHEMA, insert_defaults, read_raw_batch, write_bucketed
from articlespark.streaming import ingest as st
from frames import rows


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_box_statistics_equal_numpy(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    groups = {"normal": rng.standard_normal(700), "ties": rng.integers(0, 4, 500) / 4, "one": np.array([0.3]), "two": np.array([-1.0, 2.0]),
              "equal": np.full(40, 0.7), "tails": np.r_[rng.standard_normal(300), [50.0, -80.0, 3e5]], "five": np.array([1.0, 2, 3, 4, 100]),
              "huge": rng.standard_normal(90) * 1e12}
    data = [(g, float(x)) for g, v in groups.items() for x in v] + [("normal", None), ("empty", None)]
    random.Random(1).shuffle(data)
    out = {r.g: r for r in box_statistics(spark.createDataFrame(data, "g string, v double").repartition(5), "g", "v", accuracy).collect()}
    assert set(out) == set(groups)
    for g, v in groups.items():
        q1, median, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        lo, hi = out[g].lower_fence, out[g].upper_fence
        assert np.allclose([out[g].q1, out[g].median, out[g].q3, lo, hi], [q1, median, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)], rtol=1e-12)
        inside = v[(v >= lo) & (v <= hi)]
        assert (out[g].n, out[g].whisker_low, out[g].whisker_high, out[g].n_outliers) == (len(v), inside.min(), inside.max(), len(v) - len(inside)), g


def test_bucketed_write_back_moves_the_scores_only(spark, tmp_path):
    arts = spark.range(400).select("id", F.lit("text").alias("content"), (F.col("id") / 400).alias("sentiment_score"))
    table = write_bucketed(arts, "bucketed_articles_test", "id", 4, str(tmp_path / "t"))
    scores = spark.range(0, 400, 3).select("id", F.lit(-0.5).alias("score"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = write_back_scores(table, scores)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert rows(out, "id", "sentiment_score") == [(i, -0.5 if i % 3 == 0 else i / 400) for i in range(400)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE bucketed_articles_test")


def test_change_feed_reads_changed_parts_only(spark, tmp_path):
    rnd = random.Random(4)
    old = {i: rnd.choice(["a", "b", None]) for i in range(200)}
    new = {i: v for i, v in old.items() if i not in (17, 18)} | {33: "changed", 34: None if old[34] else "x", 500: "added"}
    want = sorted([("delete", i, old[i]) for i in old if i not in new] + [("insert", i, new[i]) for i in new if i not in old]
                  + [("update", i, new[i]) for i in new if i in old and old[i] != new[i]], key=str)
    for name, data in (("old", old), ("new", new)):
        st.write_snapshot(spark.createDataFrame(sorted(data.items()), "id long, v string"), str(tmp_path / name), F.floor(F.col("id") / 10))
    paths = str(tmp_path / "old"), str(tmp_path / "new")
    assert st.changed_parts(spark, *paths) == sorted({1, 3, 50})
    feed = st.change_feed(spark, *paths, ["id"])
    assert sorted((tuple(r) for r in feed.collect()), key=str) == want
    assert "PartitionFilters: [" in feed._jdf.queryExecution().toString()
    assert st.change_feed(spark, paths[0], paths[0], ["id"]).count() == 0


def test_snapshots_of_many_parts_hold_few_folders(spark, tmp_path):
    old = spark.range(0, 20_000, 1, 4).select("id", (F.col("id") % 7).cast("string").alias("v"))
    new = old.where("id <> 40").withColumn("v", F.when(F.col("id") == 9_000, "changed").otherwise(F.col("v")))
    for name, df in (("old", old), ("new", new)):
        st.write_snapshot(df, str(tmp_path / name), F.floor(F.col("id") / 4))
        assert len(list((tmp_path / name / "rows").glob("*=*"))) <= 64
        assert len(list((tmp_path / name / "rows").rglob("*.parquet"))) <= 200
    paths = str(tmp_path / "old"), str(tmp_path / "new")
    assert st.changed_parts(spark, *paths) == [10, 2250]
    feed = st.change_feed(spark, *paths, ["id"])
    assert rows(feed, "change", "id", "v") == [("delete", 40, "5"), ("update", 9_000, "changed")]
    assert feed._jdf.queryExecution().toString().count("PartitionFilters: [part_folder") >= 2


def _near_texts(n=60):
    rnd = random.Random(12)
    vocab = [f"word{i}" for i in range(60)]
    base = [[rnd.choice(vocab) for _ in range(25)] for _ in range(8)]
    return [(i, " ".join(w if rnd.random() > 0.08 else rnd.choice(vocab) for w in rnd.choice(base))) for i in range(n)]


def test_best_matches_verify_fewer_candidates(spark):
    docs = corpus_vectors(spark.createDataFrame(_near_texts(), "id long, _text string"))
    left, right = docs.where("id < 20"), docs.where("id >= 20")
    every = simjoin.best_match(simjoin.cross_similar_pairs(left, right, 0.6))
    assert rows(simjoin.best_matches(left, right, 0.6)) == rows(every)
    bounds = simjoin.candidate_bounds(left, right, 0.6).checkpoint()
    first, rest = simjoin.likely_first(bounds)
    tried = simjoin._verified(first, left, right)
    verified = first.count() + simjoin.still_open(rest, tried, 0.6).count()
    assert 0 < verified < bounds.count()
    # the bounds hold
    sims = {(r.left_id, r.right_id): r.sim for r in simjoin._verified(bounds.select("left_id", "right_id"), left, right).collect()}
    assert all(r.low - 1e-9 <= sims[r.left_id, r.right_id] <= r.high + 1e-9 for r in bounds.collect())


def test_postings_join_leaves_out_late_postings(spark):
    """A term that nearly all documents hold, with a small weight, joins none of its postings."""
    rnd = random.Random(2)
    texts = [(i, "common " + " ".join(f"w{rnd.randrange(4000)}" for _ in range(30))) for i in range(120)]
    docs = corpus_vectors(spark.createDataFrame(texts, "id long, _text string"))
    reach = simjoin._reach(0.85)
    posts = simjoin._postings(simjoin._prefixes(docs, reach), reach).checkpoint()
    met = simjoin._meet(posts, posts, reach)
    hot = docs.select(F.element_at("ords", -1).alias("o")).groupBy("o").count().orderBy(F.desc("count")).first()
    assert hot["count"] > 100 and met.where(F.col("ord") == hot.o).count() == 0


def test_greedy_rounds_read_fewer_edges(spark):
    chain = [(i, i + 1) for i in range(1, 12)] + [(20, k) for k in range(21, 40)]
    read = []
    res = {r.id: (r.kept, r.merged_into) for r in resolve(spark.createDataFrame(chain, "lo long, hi long"), read=read).collect()}
    assert read == sorted(read, reverse=True) and len(set(read)) == len(read) and read[0] == len(chain)
    assert res[1] == (True, None) and res[2] == (False, 1) and res[3] == (True, None) and res[39] == (False, 20)


def test_pages_without_an_id(spark):
    html = "<article><h1>A</h1><p>B</p></article>"
    pages = spark.createDataFrame([(None, "u", html), (2 ** 60 + 1, "v", html), (3, None, None)], "page_id long, url string, html string")
    out = extract_articles(pages, [PAGE_RULE])
    assert sorted((tuple(r) for r in out.select("page_id", "title", "content").collect()), key=str) == [(2 ** 60 + 1, "A", "B"), (None, "A", "B")]


def test_raw_batches_and_defaults(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"seq": 1, "title": "t", "other": 5}\n{"seq": 2, "url": "u", "date": "2025-06-01T10:00:00Z"}\n')
    batch = read_raw_batch(spark, str(tmp_path / "b.json"))
    assert batch.schema == RAW_SCHEMA and rows(batch, "seq", "url") == [(1, None), (2, "u")]
    assert read_raw_batch(spark, str(tmp_path / "missing")).count() == 0
    out = insert_defaults(batch.drop("url").withColumn("sentiment_score", F.lit(None).cast("double")))
    assert rows(out, "seq", "content_hash", "alt_sources", "sentiment_score") == [(1, "", "", 0.0), (2, "", "", 0.0)]
    assert out.where("url IS NULL").count() == 2
