"""The whole ingest as commits of the versioned article store."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from articlespark.operators.ingest import ingest_batch, ingest_into, stored_corpus
from articlespark.operators.store import empty_store, purge
from articlespark.operators.tfidf import corpus_stats, term_counts
from articlespark.functions.text import doc_text
from articlespark.sources.tables import ARTICLES_SCHEMA, RAW_SCHEMA
from articlespark.sources.versions import ArticleStore
from articlespark.streaming import ingest as st
from frames import rows

START = datetime(2025, 6, 1, 6)
WORDS = "river stone bridge harbour ferry lantern garden market winter council train festival museum storm coast".split()


def _raw(rnd, first, n, old):
    """Raw records: fresh ones, exact copies, near copies of earlier records, odd fields."""
    out = []
    for seq in range(first, first + n):
        words = [rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(14)]
        title, source = f"Story {seq}", rnd.choice(["A", "B", "C", None])
        if old and rnd.random() < 0.5:
            body = rnd.choice(old)
            words = body.split()
            if rnd.random() < 0.6:
                words[rnd.randrange(len(words))] = "changed"
        body = " ".join(words)
        old.append(body)
        when = START + timedelta(hours=4 * len(old))
        content = rnd.choice([body] * 12 + [None, ""])
        out.append((seq, title, rnd.choice([f"u{seq}"] * 9 + ["u3"]), content, "news", rnd.choice([when] * 9 + [None]), source, "s", when))
    return out


def _feed(seed=5, batches=3, n=10):
    rnd, old = random.Random(seed), []
    return [_raw(rnd, 100 * b, n, old) for b in range(batches)]


COLUMNS = ("id", "title", "url", "content", "content_hash", "alt_sources", "date", "category")


def _view(articles, sources):
    named = articles.join(sources.select(F.col("id").alias("source_id"), "name"), "source_id", "left")
    return sorted((tuple(r) for r in named.select(*COLUMNS, "name").collect()), key=str)


def _sequential(spark, feed, horizon):
    st0 = empty_store(spark)
    articles, sources = st0["articles"], st0["sources"]
    for batch in feed:
        raw = spark.createDataFrame(batch, RAW_SCHEMA)
        articles, sources, _ = ingest_batch(raw, articles, sources, batch[-1][-1], horizon_hours=horizon, threshold=0.7)
        articles, sources = articles.checkpoint(), sources.checkpoint()
    return _view(articles, sources)


@pytest.mark.parametrize("horizon", [72, None])
def test_stream_of_batches_equals_sequential_ingest(spark, tmp_path, horizon):
    feed = _feed()
    for k, batch in enumerate(feed):
        spark.createDataFrame(batch, RAW_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "raw"))
    store = ArticleStore(spark, str(tmp_path / "store"))
    stream = st.file_stream(spark, str(tmp_path / "raw"), RAW_SCHEMA, max_files=1)
    st.stream_into_store(stream, store.path, str(tmp_path / "ckpt"), horizon_hours=horizon, threshold=0.7)
    state = store.state()
    assert state["version"] == len(feed) and list(state["feeds"].values()) == [len(feed) - 1]
    got = _view(store.articles(), store.sources())
    assert got == _sequential(spark, feed, horizon)
    assert any(r[5] for r in got)  # some near copy told its source
    # every batch again, under the feed's own ids: nothing changes
    name = next(iter(state["feeds"]))
    for k, batch in enumerate(feed):
        assert not ingest_into(store, spark.createDataFrame(batch, RAW_SCHEMA), horizon_hours=horizon, feed=name, batch_id=k)
    assert store.state() == state


def test_failed_commit_leaves_nothing_and_is_replayed(spark, tmp_path, monkeypatch):
    feed = _feed(seed=8, batches=2)
    frames = [spark.createDataFrame(b, RAW_SCHEMA) for b in feed]
    store = ArticleStore(spark, str(tmp_path / "s"))
    ingest_into(store, frames[0], feed="f", batch_id=0)
    before, held = store.state(), rows(store.articles(), "id")
    monkeypatch.setattr(ArticleStore, "_record", lambda self, state: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ingest_into(store, frames[1], feed="f", batch_id=1)
    monkeypatch.undo()
    assert store.state() == before and rows(store.articles(), "id") == held
    tried = spark.read.schema(store.articles().schema).parquet(f"{store.path}/articles/version=2").drop("day").collect()
    assert ingest_into(store, frames[1], feed="f", batch_id=1)
    days = [d for d, v in store.state()["articles"].items() if v == 2]
    again = store.articles().where(F.col("day").isin(days)).drop("day").collect()
    assert sorted(map(tuple, tried), key=str) == sorted(map(tuple, again), key=str) and len(rows(store.articles(), "id")) > len(held)


def test_stored_frequencies_equal_a_refit(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "s"))
    feed = _feed(seed=3, batches=3)
    for k, batch in enumerate(feed):
        ingest_into(store, spark.createDataFrame(batch, RAW_SCHEMA), feed="f", batch_id=k)
    articles, now = store.articles(), feed[-1][-1][-1]
    for hours in (None, 72, 31):
        corpus = articles.where("source_id IS NOT NULL")
        if hours is not None:
            corpus = corpus.where(F.col("date") >= F.lit(now - timedelta(hours=hours)))
        corpus = corpus.select("id", doc_text("title", "content").alias("text")).where("text IS NOT NULL")
        tc = term_counts(corpus, "id", "text")
        known = stored_corpus(store, store.state(), now, hours)
        assert rows(known.counts) == rows(tc)
        assert rows(known.stats) == rows(corpus_stats(tc))
        assert store.spark.range(1).select(known.documents).first()[0] == corpus.count()


def test_only_touched_days_are_written(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "s"))

    def record(seq, day, body, source="A"):
        at = START + timedelta(days=day)
        return (seq, f"t{seq}", f"u{seq}", body, "c", at, source, "s", at)

    ingest_into(store, spark.createDataFrame([record(1, 0, "quiet harbour lantern walk"), record(2, 1, "storm over coast road"),
                                              record(3, 2, "market day in winter")], RAW_SCHEMA))
    first = store.state()
    assert first["articles"] == {f"2025-06-0{d}": 1 for d in (1, 2, 3)}
    # a near copy of the second day's article, and a new article of a fourth day
    ingest_into(store, spark.createDataFrame([record(11, 3, "storm over coast road", "B"), record(12, 3, "museum opens new wing")], RAW_SCHEMA),
                threshold=0.6)
    assert store.state()["articles"] == {"2025-06-01": 1, "2025-06-02": 2, "2025-06-03": 1, "2025-06-04": 2}
    assert rows(store.articles(), "id", "alt_sources") == [(1, ""), (2, "B"), (3, ""), (4, "")]
    assert rows(store.articles(first), "id", "alt_sources") == [(1, ""), (2, ""), (3, "")]  # the old version still reads
    ranged = store.articles(since="2025-06-02", until="2025-06-03")
    assert rows(ranged, "id") == [(2,), (3,)]
    assert len(ranged.inputFiles()) < len(store.articles().inputFiles())
    assert "PartitionFilters: [isnotnull(day" in store.articles().where("day >= '2025-06-02'")._jdf.queryExecution().toString()


def test_purge_is_a_commit_of_whole_days(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "s"))
    feed = _feed(seed=4, batches=2)
    for k, batch in enumerate(feed):
        ingest_into(store, spark.createDataFrame(batch, RAW_SCHEMA), feed="f", batch_id=k)
    before, now = store.articles().drop("day").checkpoint(), START + timedelta(days=23)
    kept, deleted = purge(before, now, days=22)
    assert 0 < deleted.count() < before.count()
    assert store.purge(now, days=22)
    assert rows(store.articles(), "id") == rows(kept, "id")
    assert store.purge(now, days=22) == []
    known = stored_corpus(store, store.state(), now, None)
    corpus = kept.where("source_id IS NOT NULL").select("id", doc_text("title", "content").alias("text")).where("text IS NOT NULL")
    assert rows(known.counts) == rows(term_counts(corpus, "id", "text"))
    assert store.spark.range(1).select(known.documents).first()[0] == corpus.count()
    ingest_into(store, spark.createDataFrame([feed[0][0]], RAW_SCHEMA), feed="g", batch_id=0)  # a purged article may come again
    assert store.articles().count() == kept.count() + 1


def _contents(store, since=None, until=None):
    """What a store holds, whatever its folders."""
    return [sorted(map(tuple, df.collect()), key=str)
            for df in (store.articles(since=since, until=until), store.terms(since=since), store.term_days(since=since))]


def _commit(store, ids_and_days, updates=()):
    """Articles (id, days after START or None) as one commit without matching."""
    data = [(i, f"t{i}", None, "x", f"h{i}", "", None if d is None else START + timedelta(days=d), "c", 1, 0.0) for i, d in ids_and_days]
    by_name = dict(zip(("id", "title", "url", "content", "content_hash", "alt_sources", "date", "category", "source_id", "sentiment_score"), range(10)))
    inserted = store.spark.createDataFrame([tuple(r[by_name[c]] for c in ARTICLES_SCHEMA.names) for r in data], ARTICLES_SCHEMA)
    terms = inserted.select("id", "date", F.expr("array(struct('x' AS term, 1L AS tf)) AS terms"))
    sources = store.spark.createDataFrame([(1, "A", "")], "id long, name string, url string")
    store.commit(store.state(), inserted, store.spark.createDataFrame(list(updates), "id long, alt_sources string"), sources, terms)


def test_spans_of_days_hold_what_days_hold(spark, tmp_path):
    by_day, spans = ArticleStore(spark, str(tmp_path / "days")), ArticleStore(spark, str(tmp_path / "spans"), day_folders=3, span_rows=6)
    steps = [([(i, i // 2) for i in range(40)] + [(90, None)], []), ([(100, 3), (101, 30)], [(20, "B"), (90, "C")]), None, ([(110, 1), (111, 8)], [(24, "D")])]
    for step in steps:
        for store in (by_day, spans):
            if step is None:
                assert len(store.purge(START + timedelta(days=15), days=8)) == 7  # cuts a span; a purged day comes again later
            else:
                _commit(store, *step)
    assert spans.state()["spans"] and _contents(spans) == _contents(by_day)
    assert spans.state()["articles"].keys() == by_day.state()["articles"].keys()
    for since, until in (("2025-06-09", "2025-06-12"), ("2025-06-11", None), ("2030-01-01", None)):
        assert _contents(spans, since, until) == _contents(by_day, since, until)
    assert len(spans.articles(since="2025-06-09", until="2025-06-12").inputFiles()) < len(spans.articles().inputFiles())


def test_folders_do_not_grow_with_days(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "s"))
    store.span_rows = 100
    _commit(store, [(i, i) for i in range(400)])
    for table in ("articles", "terms", "term_days"):
        assert len(list((tmp_path / "s" / table / "version=1").iterdir())) < 10
    assert store.articles().select("day").distinct().count() == 400 and store.term_days().count() == 800
    # a change of one article writes its span again, and no other
    _commit(store, [], [(150, "B")])
    assert sorted(store.state()["articles"].values()).count(2) == 100
    assert rows(store.articles().where("alt_sources = 'B'"), "id") == [(150,)] and store.articles().count() == 400


def test_empty_store_and_empty_batch(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "s"))
    assert store.state()["version"] == 0 and store.articles().count() == store.sources().count() == store.terms().count() == 0
    ingest_into(store, spark.createDataFrame([], RAW_SCHEMA), feed="f", batch_id=0)
    assert store.state()["version"] == 1 and store.articles().count() == 0 and store.is_done("f", 0)
