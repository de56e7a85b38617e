"""WARC archives of pages, read back, and a globally ordered capture index.

``write_archives`` turns pages into archive segments: gzip members, one WARC
record each, many records to a segment.  Segments are rows of a table that Spark
writes (so any shared store will do); ``export`` joins them into .warc.gz files.
``read_archives`` parses the segments again and checks each payload's digest.
``merge_index`` sorts the captures externally: every segment is a run that is
sorted where it was read, rows are dealt by ranges of the whole key (URL key,
timestamp, page), and each range merges its runs with a loser tree, so that the
ranges in order are one globally ordered list of capture histories.

Defined results: a null html is an empty payload; a null url gives the empty URL
key; a row with a null page_id is a response that nothing refers to; repeated
rows of the smallest page_id are all responses; an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import ready

SEGMENT_BYTES = 4 << 20
#: Index rows that one range of the external merge aims at.
RANGE_ROWS = 200_000
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)

ARCHIVE_SCHEMA = "segment string, records bigint, data binary"
INDEX_SCHEMA = ("url_key string, ts string, page_id bigint, url string, payload_bytes bigint, "
                "payload_digest string, record_type string, refers_to bigint, "
                "segment string, offset bigint, length bigint")


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then the path, in lower case, without scheme,
    leading ``www.``, fragment or default port: captures of a site sort together."""
    if not url:
        return ""
    m = re.match(r"(?:([a-z][a-z0-9+.-]*):)?//([^/?#]*)([^#]*)", url.strip().lower())
    if not m:
        return url.strip().lower()
    host = m[2].rpartition("@")[2]
    host = re.sub(r":(?:80|443)?$", "", re.sub(r"^www\d*\.", "", host))
    return ",".join(reversed(host.split("."))) + ")" + (m[3] or "/")


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _stamp(page_id: int | None) -> datetime:
    """Pages carry no capture time: one second for each page_id, wrapped to 30 years."""
    return EPOCH + timedelta(seconds=(page_id or 0) % 946_080_000)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has headers only and names the record it refers to."""
    when = _stamp(page_id)
    name = "none" if page_id is None else str(page_id)
    head = [("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", f"<urn:page:{name}>"),
            ("WARC-Date", when.strftime("%Y-%m-%dT%H:%M:%SZ")),
            ("WARC-Payload-Digest", f"sha1:{bare_digest(payload)}"),
            ("X-Payload-Length", str(len(payload)))]
    if url is not None:
        head.insert(2, ("WARC-Target-URI", re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        payload = b""
    body = http + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (the HTTP body) of one record."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = top.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[:int(head["Content-Length"])]
    return head, block.partition(b"\r\n\r\n")[2]


def mark_revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to) for each page: of equal payloads of at least
    ``min_revisit_bytes`` bytes the smallest page_id keeps its payload, others refer to
    it.  Only digests are grouped (combined before the shuffle); payloads that occur
    once skip the join's matches, and a hot payload's rows are split by AQE."""
    p = pages.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("sha", F.sha1("payload"))
    firsts = (p.where(F.col("page_id").isNotNull() & (F.length("payload") >= min_revisit_bytes))
              .groupBy(F.col("sha").alias("sha_of"))
              .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
              .where("copies > 1").select("sha_of", "first"))
    return p.join(firsts, p.sha == firsts.sha_of, "left").select(
        "page_id", "url", "payload", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    data, count = bytearray(), 0

    def segment():
        return pa.RecordBatch.from_arrays(
            [pa.array([f"crawl-{part:06d}-{number:06d}"]), pa.array([count], pa.int64()),
             pa.array([bytes(data)], pa.binary())], names=["segment", "records", "data"])

    for batch in batches:
        for k in range(batch.num_rows):
            page, url, payload, refers = (batch.column(c)[k].as_py() for c in range(4))
            data += gzip.compress(record(page, url, bytes(payload), refers), 3, mtime=0)
            count += 1
            if len(data) >= SEGMENT_BYTES:
                yield segment()
                number, count = number + 1, 0
                data.clear()
    if count:
        yield segment()


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Write one WARC record for each page into segments under ``path``."""
    ready(pages.sparkSession)
    mark_revisits(pages, min_revisit_bytes).mapInArrow(_write, ARCHIVE_SCHEMA).write.parquet(path)


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, content) of each gzip member."""
    at, view = 0, memoryview(data)
    while at < len(data):
        z, raw, end = zlib.decompressobj(31), [], at
        while not z.eof:
            if end >= len(data):
                raise ValueError(f"the record at {at} is cut off")
            raw.append(z.decompress(view[end:end + 65536]))
            end = min(len(data), end + 65536)
        end -= len(z.unused_data)
        yield at, end - at, b"".join(raw)
        at = end


def _entries(segment: str, data: bytes) -> list[tuple]:
    out = []
    for at, size, raw in members(data):
        head, payload = parse(raw)
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        revisit = head["WARC-Type"] == "revisit"
        if not revisit and (bare_digest(payload) != digest or len(payload) != int(head["X-Payload-Length"])):
            raise ValueError(f"{segment} at {at}: the payload does not match its digest")
        page = head["WARC-Record-ID"][len("<urn:page:"):-1]
        refers = int(head["WARC-Refers-To"][len("<urn:page:"):-1]) if revisit else None
        url = head.get("WARC-Target-URI")
        out.append((url_key(url), re.sub(r"\D", "", head["WARC-Date"]), None if page == "none" else int(page), url,
                    int(head["X-Payload-Length"]), digest, head["WARC-Type"], refers, segment, at, size))
    return out


_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(),
          pa.int64(), pa.string(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS)], names=_NAMES)


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield _batch(sorted(_entries(batch.column(0)[k].as_py(), batch.column(2)[k].as_py()), key=_order))


def read_archives(archives: DataFrame) -> DataFrame:
    """The index entries of all records, each segment's sorted as one run."""
    ready(archives.sparkSession)
    return archives.select("segment", "records", "data").mapInArrow(_read, INDEX_SCHEMA)


class LoserTree:
    """k-way merge of sorted runs.  Each inner node keeps the loser of its match, so
    the next row costs one match per level."""

    def __init__(self, runs: list[list[tuple]], key):
        self.key, self.runs = key, [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.heads: list[tuple | None] = [None] * self.k  # (key, row), None when a run is used up
        for i in range(len(runs)):
            self._advance(i)
        self.losers = [-1] * self.k
        self.winner = self._play(1)

    def _advance(self, i: int) -> None:
        row = next(self.runs[i], None)
        self.heads[i] = None if row is None else (self.key(row), row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self):
        while self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i][1]
            if i < len(self.runs):
                self._advance(i)
            node = (i + self.k) // 2
            while node >= 1:
                if self._beats(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            runs.setdefault(row[8], []).append(row)
    # Rows of a run keep their order through the shuffle unless it was re-sorted on the way.
    for rows in runs.values():
        if any(_order(a) > _order(b) for a, b in zip(rows, rows[1:])):
            rows.sort(key=_order)
    out: list[tuple] = []
    for row in LoserTree(list(runs.values()), _order):
        out.append(row)
        if len(out) == 10_000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def merge_index(entries: DataFrame, rows: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """External merge of the runs.  The ranges are cut by the whole key, so one URL's
    captures spread over ranges too; a task holds about ``range_rows`` rows."""
    spark = entries.sparkSession
    ready(spark)
    parts = max(spark.sparkContext.defaultParallelism, -(-rows // range_rows))
    return entries.repartitionByRange(parts, "url_key", "ts", "page_id", "segment", "offset") \
        .mapInArrow(_merge, INDEX_SCHEMA)


def archive_and_index(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the pages' archives to the shared scratch folder, read them back and
    return the globally ordered index."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_revisit_bytes)
    archives = spark.read.parquet(path)
    entries = scratch_path(spark, "warc-runs")
    read_archives(archives).write.parquet(entries)
    runs = spark.read.parquet(entries)
    return merge_index(runs, runs.count())


def export(archives: DataFrame, folder: str) -> None:
    """Write each segment as ``<folder>/<segment>.warc.gz``; ``folder`` is a path that
    all tasks share and can write to."""
    import os

    def write(rows):
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(os.path.join(folder, f"{r['segment']}.warc.gz"), "wb") as f:
                f.write(r["data"])

    archives.foreachPartition(write)
