"""The article store as files: articles by day, sources, term counts, a commit log.

Every commit writes new folders and then one small commit record that names the folders
of the store's tables; a reader takes the newest record, so it sees a commit whole or not at all, and
what a failed attempt left behind is in no record.

* ``articles/version=N/day=D``: the newest version of each day.  A commit rewrites only the days
  that it changes; the record maps days to versions, and readers that give a date range open
  those days only.
* ``terms/version=N/day=D`` (id, date, terms) and ``term_days/version=N/day=D`` (term,
  df, corpus_tf; the null term's df is the number of documents): added by the commit
  that inserts the articles, never rewritten.
* ``.../version=N/span=D``: where a commit writes more than ``day_folders`` days, its folders hold
  spans of days that follow each other, about ``span_rows`` articles or one day each, and are named by their
  first day; the record lists the spans of such versions.  A span is rewritten whole, so its days
  share a version; readers filter by day where a purge or a date range cuts it.
* ``sources/version=N``: the whole dimension (small).

A record also keeps the last batch of each feed, so a batch that is replayed after its
commit changes nothing.  One writer at a time; rows without a date are in ``UNDATED``.
"""

from __future__ import annotations

import bisect
import datetime
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .tables import ARTICLES_SCHEMA, SOURCES_SCHEMA

UNDATED = "undated"
#: Files of document frequencies in a folder, at most.
TERM_PARTS = 8
TERMS_SCHEMA = "id bigint, date timestamp, terms array<struct<term: string, tf: bigint>>, day string"
TERM_DAYS_SCHEMA = "term string, df bigint, corpus_tf bigint, day string"
DAY_ARTICLES = T.StructType([*ARTICLES_SCHEMA.fields, T.StructField("day", T.StringType())])


def day_of(date: str | Column = "date") -> Column:
    date = F.col(date) if isinstance(date, str) else date
    return F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit(UNDATED))


def cut_spans(rows_of_day: dict[str, int], span_rows: int) -> list[str]:
    """The first days of spans of about ``span_rows`` rows; undated rows have their own."""
    firsts, held = [], 0
    for day in sorted(rows_of_day):
        if not firsts or held >= span_rows or day == UNDATED:
            firsts.append(day)
            held = 0
        held += rows_of_day[day]
    return firsts


def _day_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(folder, day, term, df, corpus_tf)`` of the rows (day, terms, folder) of each batch; the null term's df is
    the number of rows."""
    for batch in batches:
        day, terms = batch.column(0).dictionary_encode(), batch.column(1)
        if not len(day):
            continue
        of = day.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        entries = terms.flatten()
        term = entries.field("term").dictionary_encode()
        n = max(1, len(term.dictionary))
        key = np.repeat(of, terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) * n + term.indices.to_numpy(zero_copy_only=False)
        key, at, df = np.unique(key, return_inverse=True, return_counts=True)
        total = np.zeros(len(key), dtype=np.int64)
        np.add.at(total, at, entries.field("tf").to_numpy(zero_copy_only=False))
        days = np.arange(len(day.dictionary))
        at_day, code = np.concatenate([key // n, days]), pa.array(np.concatenate([key % n, days * 0]), mask=np.arange(len(key) + len(days)) >= len(key))
        first = np.unique(of, return_index=True)[1]
        yield pa.RecordBatch.from_arrays([
            batch.column(2).take(pa.array(first[at_day])), day.dictionary.take(pa.array(at_day)), term.dictionary.take(code),
            pa.array(np.concatenate([df, np.bincount(of, minlength=len(days))])),
            pa.array(np.concatenate([total, days * 0]), mask=np.arange(len(key) + len(days)) >= len(key))], names=["folder", "day", "term", "df", "corpus_tf"])


class ArticleStore:
    def __init__(self, spark: SparkSession, path: str, day_folders: int = 64, span_rows: int = 20_000):
        self.spark, self.path = spark, path.rstrip("/")
        self.day_folders, self.span_rows = day_folders, span_rows

    # -- commit log ------------------------------------------------------
    def _committed(self) -> list[int]:
        """Versions with a commit record: one file, which its write moves into place whole."""
        found = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/version=*/part-*")  # noqa: SLF001
        status = found.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(found)  # noqa: SLF001
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in status or [])

    def state(self) -> dict:
        """The newest commit record."""
        versions = self._committed()
        if not versions:
            return {"version": 0, "feeds": {}, "articles": {}, "terms": [], "sources": None, "spans": {}}
        return json.loads(self.spark.read.text(f"{self.path}/commits/version={versions[-1]}").first()[0])

    def _record(self, state: dict) -> dict:
        """Written last: the commit happens here."""
        record = self.spark.createDataFrame([(json.dumps(state, sort_keys=True),)], "value string").coalesce(1)
        record.write.mode("overwrite").text(f"{self.path}/commits/version={state['version']}")
        return state

    # -- reading -----------------------------------------------------------
    def _read(self, table: str, folders: list[str], schema: T.StructType, known: T.StructType | None = None) -> DataFrame:
        base = f"{self.path}/{table}"
        known = T.StructType([*(known or schema).fields, T.StructField("version", T.LongType())])
        return self.spark.read.schema(known).option("basePath", base).parquet(*(f"{base}/{f}" for f in folders))

    @staticmethod
    def _span(firsts: list[str], day: str) -> str:
        return firsts[bisect.bisect_right(firsts, day) - 1]

    def _read_days(self, table: str, held: list[tuple[int, list[str]]], schema: T.StructType, state: dict) -> DataFrame:
        """The rows of the given days of each version; of spans, only those that hold such a day are opened."""
        folders, spans, within = [], [], F.lit(False)
        for v, days in held:
            firsts = state.get("spans", {}).get(str(v))
            if firsts is None:
                folders += [f"version={v}/day={d}" for d in days]
            elif days:
                spans += [f"version={v}/span={x}" for x in sorted({self._span(firsts, d) for d in days})]
                # What is not wanted of these spans lies before or behind: purges and date ranges cut so.
                within = within | ((F.col("version") == v) & F.col("day").between(min(days), max(days)))
        found = [self._read(table, folders, schema).select(*schema.names)] if folders else []
        if spans:
            known = T.StructType([*schema.fields, T.StructField("span", T.StringType())])
            found.append(self._read(table, spans, schema, known).where(within).select(*schema.names))
        if not found:
            return self.spark.createDataFrame([], schema)
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    @staticmethod
    def _days(days, since, until) -> list[str]:
        """Those of ``days`` that may hold dates of since..until (no bound: also undated rows)."""
        if since is None and until is None:
            return sorted(days)
        lo, hi = (str(d)[:10] if d is not None else None for d in (since, until))
        return sorted(d for d in days if d != UNDATED and (lo is None or d >= lo) and (hi is None or d <= hi))

    def articles(self, state: dict | None = None, since=None, until=None) -> DataFrame:
        """Articles and their ``day``; with bounds (dates), only the days within are opened."""
        state = state or self.state()
        held = {}
        for d in self._days(state["articles"], since, until):
            held.setdefault(state["articles"][d], []).append(d)
        return self._read_days("articles", sorted(held.items()), DAY_ARTICLES, state)

    def sources(self, state: dict | None = None) -> DataFrame:
        state = state or self.state()
        if state["sources"] is None:
            return self.spark.createDataFrame([], SOURCES_SCHEMA)
        return self._read("sources", [f"version={state['sources']}"], SOURCES_SCHEMA).select(*SOURCES_SCHEMA.names)

    def _counts(self, table: str, schema: str, state: dict | None, since) -> DataFrame:
        state = state or self.state()
        schema = T._parse_datatype_string(schema)  # noqa: SLF001
        stored = state["articles"].keys()
        return self._read_days(table, [(v, self._days(stored & days, since, None)) for v, days in state["terms"]], schema, state)

    def terms(self, state: dict | None = None, since=None) -> DataFrame:
        """(id, date, terms, day) of every stored article that has a text."""
        return self._counts("terms", TERMS_SCHEMA, state, since)

    def term_days(self, state: dict | None = None, since=None) -> DataFrame:
        """(term, df, corpus_tf, day): what each commit added to a day."""
        return self._counts("term_days", TERM_DAYS_SCHEMA, state, since)

    # -- writing -------------------------------------------------------------
    def is_done(self, feed: str, batch_id: int, state: dict | None = None) -> bool:
        return (state or self.state())["feeds"].get(feed, -1) >= batch_id

    def _write(self, df: DataFrame, table: str, version: int, firsts: list[str] | None, days: list[str], dealt: bool = False) -> None:
        """A table's rows into this version's folders, by day or by the spans that begin with
        ``firsts``; a large one becomes several files.  ``dealt``: a task has the rows of few folders already."""
        by = "day"
        if firsts is not None:
            by = "span"
            spans = self.spark.createDataFrame([(d, self._span(firsts, d)) for d in days], "day string, span string")
            df = df.join(F.broadcast(spans), "day")
        df = df if dealt else df.hint("rebalance", by)
        df.write.partitionBy(by).mode("overwrite").parquet(f"{self.path}/{table}/version={version}")

    def _span_mates(self, state: dict, days: set[str]) -> set[str]:
        """The stored days that share a span with one of ``days``."""
        spans, stored = state.get("spans", {}), state["articles"]
        span = lambda d: (stored[d], self._span(spans[str(stored[d])], d))
        held = {span(d) for d in days if d in stored and str(stored[d]) in spans}
        return {d for d, v in stored.items() if str(v) in spans and span(d) in held} if held else set()

    def commit(self, state: dict, inserted: DataFrame, updates: DataFrame, sources: DataFrame,
               terms: DataFrame | Callable[[DataFrame], DataFrame], feed: str | None = None, batch_id: int = 0) -> dict:
        """One batch into the store that ``state`` tells of.

        ``inserted``: whole new rows (ARTICLES_SCHEMA); ``updates`` (id, alt_sources):
        changed rows; ``sources``: the dimension after the batch; ``terms``
        (TERMS_SCHEMA): the term counts of the inserted rows, or a function that makes them from
        these rows (``day`` with them; in a new store as they are stored).  All but the terms are read
        more than once, so they should be tables or cheap to read again.  Only days with an inserted or
        changed row, and days that share a span with one, are written again."""
        version = state["version"] + 1
        names = ARTICLES_SCHEMA.names
        inserted = inserted.select(*names, day_of().alias("day"))
        more = {r[0]: r[1] for r in inserted.groupBy("day").count().collect()}
        added = sorted(more)
        changed = updates.select("id", F.col("alt_sources").alias("_alt"))
        days = {r[0] for r in self.articles(state).select("id", "day").join(changed, "id").select("day").distinct().collect()} | set(added)
        days |= self._span_mates(state, days)
        new = {**state, "version": version, "feeds": dict(state["feeds"]), "spans": dict(state.get("spans", {}))}
        firsts = None
        if days:
            touched = {**state, "articles": {d: v for d, v in state["articles"].items() if d in days}}
            old = self.articles(touched)
            if len(days) > self.day_folders:
                for d, n in old.groupBy("day").count().collect():
                    more[d] = more.get(d, 0) + n
                firsts = new["spans"][str(version)] = cut_spans(more, self.span_rows)
            old = old.join(changed, "id", "left").withColumn("alt_sources", F.coalesce("_alt", "alt_sources"))
            self._write(old.select(*names, "day").unionByName(inserted), "articles", version, firsts, sorted(days))
            new["articles"] = {**state["articles"], **{d: version for d in days}}
        if added:
            stored = False
            if callable(terms):
                held = inserted if state["articles"] else self.articles(new)
                # As many files as cores or more: tasks write what they read, so texts are shuffled once.
                stored = held is not inserted and len(held._jdf.inputFiles()) >= self.spark.sparkContext.defaultParallelism  # noqa: SLF001
                terms = terms(held)
            self._write(terms.withColumn("day", day_of()), "terms", version, firsts, added, dealt=stored)
            # Counted from what was just written, not made again.
            schema, by = T._parse_datatype_string(TERMS_SCHEMA), "day" if firsts is None else "span"  # noqa: SLF001
            known = schema if firsts is None else T.StructType([*schema.fields, T.StructField(by, T.StringType())])
            counted = self._read("terms", [f"version={version}"], schema, known)
            ship_package(self.spark)
            rows = counted.select("day", "terms", F.col(by).alias("folder")).mapInArrow(_day_counts, "folder string, day string, term string, df bigint, corpus_tf bigint")
            sums = rows.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(TERM_PARTS))).repartition("folder", "part") \
                .groupBy("folder", "part", "day", "term").agg(F.sum("df").alias("df"), F.sum("corpus_tf").alias("corpus_tf"))
            self._write(sums.select("day", "term", "df", "corpus_tf"), "term_days", version, firsts, added, dealt=True)
            new["terms"] = [*state["terms"], [version, sorted(r[0] for r in counted.select("day").distinct().collect())]]
        sources.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sources/version={version}")  # a small dimension
        new["sources"] = version
        if feed is not None:
            new["feeds"][feed] = batch_id
        return self._record(new)

    def purge(self, now, days: int = 30) -> list[str]:
        """D12 on whole days: those strictly before ``now - days`` leave the store by a commit
        record alone; undated rows stay.  Returns the days that went."""
        now = now if isinstance(now, datetime.datetime) else datetime.datetime.fromisoformat(str(now))
        cutoff = (now.date() - datetime.timedelta(days=days)).isoformat()
        state = self.state()
        gone = {d for d in state["articles"] if d != UNDATED and d < cutoff}
        if gone:
            self._record({**state, "version": state["version"] + 1,
                          "articles": {d: v for d, v in state["articles"].items() if d not in gone},
                          "terms": [[v, left] for v, held in state["terms"] if (left := [d for d in held if d not in gone])]})
        return sorted(gone)
