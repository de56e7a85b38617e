"""Benchmark decontamination with one FM-index per training shard.

A shard is a chunk of whole documents.  Its words become symbols of the test
set's vocabulary; words outside it (and document ends) part the text into runs,
and runs shorter than the shortest phrase can hold no phrase, so they are left
out of the index (no occurrence is lost).  Over the remaining symbols the shard
builds a suffix array, its Burrows-Wheeler transform in a wavelet matrix, and
sampled suffix positions.  All phrases are searched backward at once by wavelet
ranks, occurrences are located by walking to the next sampled position, and
overlapping occurrences are merged into removal spans.

Defined results: a null or empty text, or one without words, has no words, hits
or spans; an item without words is never found; an item of fewer than
``window`` words is one phrase; repeated rows are judged one by one; rows with
a null item_id are left out; other columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready
from .words import ALNUM_WORDS, Words, iter_words

SHARD_BYTES = 4 << 20
SAMPLE_EVERY = 16
#: Test-set text that one pass over the documents holds; a larger set takes
#: several passes (see ``find_contamination``).
PASS_BYTES = 32 << 20


class WaveletMatrix:
    """Ranks and symbols of a sequence, by levels of bits."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(int(len(seq) - ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        start, end = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            up = ((symbols >> (self.levels - 1 - k)) & 1).astype(bool)
            s1, e1 = ones[start], ones[end]
            start = np.where(up, zeros + s1, start - s1)
            end = np.where(up, zeros + e1, end - e1)
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        out = np.zeros(len(at), dtype=np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            before = ones[at]
            up = (ones[at + 1] - before).astype(bool)
            out = (out << 1) | up
            at = np.where(up, zeros + before, at - before)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling.  Symbol 0 parts runs; each 0 counts
    as a symbol of its own (in text order), so no comparison passes a run's end."""
    zeros = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    n, width = len(text), 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[:max(0, n - width)] = rank[width:] + 1
        key = rank * (max(int(after.max(initial=0)), int(rank.max(initial=0))) + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        step = np.empty(n, dtype=np.int64)
        step[:1] = 0
        np.cumsum(key[1:] != key[:-1], out=step[1:])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = step
        if n == 0 or step[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Count and locate phrases in a text of symbols 1.. with 0 between runs;
    the text ends with 0."""

    def __init__(self, text: np.ndarray, sigma: int, every: int = SAMPLE_EVERY):
        order = suffix_array(text)
        self.before = np.zeros(sigma + 1, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.before[1:])
        self.wavelet = WaveletMatrix(text[order - 1], sigma)
        run_start = np.ones(len(text), dtype=bool)
        run_start[1:] = text[:-1] == 0
        self.sampled = ((order % every) == 0) | run_start[order]
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the phrases (right-aligned rows of symbols, 0 before)."""
        n, width = phrases.shape
        lo = np.zeros(n, dtype=np.int64)
        hi = np.full(n, int(self.before[-1]), dtype=np.int64)
        live = np.arange(n)
        for k in range(width):
            live = live[(lengths[live] > k) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = phrases[live, width - 1 - k]
            lo[live] = self.before[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.before[c] + self.wavelet.rank(c, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back to the next sampled position."""
        out = np.empty(len(rows), dtype=np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            done = self.sampled[rows]
            out[todo[done]] = self.samples[self.sample_rank[rows[done]]] + steps
            todo, rows = todo[~done], rows[~done]
            if len(rows):
                c = self.wavelet.access(rows)
                rows = self.before[c] + self.wavelet.rank(c, rows)
            steps += 1
        return out


class Phrases:
    """The windows of a set of items, as symbols of the items' own vocabulary."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        texts = pa.array([t for _, t in items], type=pa.large_string())
        hashes: list[np.ndarray] = []
        for w in iter_words(texts, ALNUM_WORDS):
            h = w.hashes()
            hashes += [h[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        self.window = window
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
        rows: dict[tuple, set[int]] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        for (name, _), h in zip(items, hashes):
            s = np.searchsorted(self.vocabulary, h) + 1
            for a in range(max(1, len(s) - window + 1) if len(s) else 0):
                rows.setdefault(tuple(s[a:a + window].tolist()), set()).add(number[name])
        self.lengths = np.array([len(r) for r in rows], dtype=np.int64)
        self.table = np.zeros((len(rows), window), dtype=np.int64)
        for k, r in enumerate(rows):
            self.table[k, window - len(r):] = r
        owners = [sorted(v) for v in rows.values()]
        self.owner_at = np.concatenate([[0], np.cumsum([len(v) for v in owners], dtype=np.int64)]).astype(np.int64)
        self.owners = np.array([x for v in owners for x in v], dtype=np.int64)
        self.shortest = int(self.lengths.min()) if len(rows) else 0
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 outside the vocabulary."""
        out = np.zeros(len(hashes), dtype=np.int64)
        at = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        h = hashes[at]
        k = np.minimum(np.searchsorted(self.vocabulary, h), max(0, len(self.vocabulary) - 1))
        found = self.vocabulary[k] == h if len(self.vocabulary) else np.zeros(len(h), bool)
        out[at[found]] = k[found] + 1
        return out


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, count of them."""
    total = int(counts.sum())
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)


def scan_shard(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hit mask of the shard's words, documents, items) with one (document,
    item) pair for each item that occurs in a document."""
    hit = np.zeros(len(words.starts), dtype=bool)
    none = np.empty(0, dtype=np.int64)
    if not phrases.shortest or not len(hit):
        return hit, none, none
    symbols = phrases.symbols(words.hashes())
    known = symbols > 0
    head = known.copy()
    head[1:] &= ~known[:-1]
    firsts = words.first[:-1][words.first[:-1] < words.first[1:]]
    head[firsts] = known[firsts]
    begin = np.flatnonzero(head)
    run_of = np.cumsum(head) - 1
    length = np.bincount(run_of[known], minlength=len(begin))
    keep = length >= phrases.shortest
    begin, length = begin[keep], length[keep]
    if not len(begin):
        return hit, none, none
    at = np.zeros(int(length.sum()) + len(begin), dtype=np.int64)  # shard word of each text position
    text = np.zeros(len(at), dtype=np.int64)
    spot = _spread(np.cumsum(length + 1) - length - 1, length)
    at[spot] = _spread(begin, length)
    text[spot] = symbols[at[spot]]
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    lo, hi = index.search(phrases.table, phrases.lengths)
    found = np.flatnonzero(hi > lo)
    count = (hi - lo)[found]
    position = index.locate(_spread(lo[found], count))
    phrase = np.repeat(found, count)
    word = at[position]
    cover = np.zeros(len(hit) + 1, dtype=np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + phrases.lengths[phrase], -1)
    hit = np.cumsum(cover[:-1]) > 0
    doc = np.searchsorted(words.first, word, side="right") - 1
    pair = np.unique(np.stack([doc, phrase]), axis=1) if len(doc) else np.empty((2, 0), np.int64)
    owners = phrases.owner_at[pair[1] + 1] - phrases.owner_at[pair[1]]
    item = phrases.owners[_spread(phrases.owner_at[pair[1]], owners)]
    both = np.unique(np.stack([np.repeat(pair[0], owners), item]), axis=1)
    return hit, both[0], both[1]


SPAN = "struct<first_word:bigint,last_word:bigint,byte_start:bigint,byte_end:bigint>"


def _merge(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["first_word"]):
        if out and s["first_word"] <= out[-1]["last_word"] + 1:
            if s["last_word"] > out[-1]["last_word"]:
                out[-1] = out[-1] | {k: s[k] for k in ("last_word", "byte_end")}
        else:
            out.append(s)
    return out


def _scan_batches(phrases, carry: list[str], again: bool, keep_text: bool):
    """The mapInArrow function of one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Phrases = phrases.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            n_words: list[int] = []
            spans: list[list[dict]] = []
            items: list[list[str]] = []
            for w in iter_words(column, ALNUM_WORDS, SHARD_BYTES):
                hit, docs, found = scan_shard(w, p)
                n_words += w.counts().tolist()
                here: list[list[dict]] = [[] for _ in range(w.lo, w.hi)]
                names: list[list[str]] = [[] for _ in range(w.lo, w.hi)]
                edge = hit.copy()
                edge[1:] &= ~hit[:-1]
                firsts = w.first[:-1][w.first[:-1] < w.first[1:]]
                edge[firsts] = hit[firsts]
                begin = np.flatnonzero(edge)
                size = np.bincount((np.cumsum(edge) - 1)[hit], minlength=len(begin))
                doc = np.searchsorted(w.first, begin, side="right") - 1
                for d, a, b in zip(doc.tolist(), begin.tolist(), (begin + size - 1).tolist()):
                    here[d].append({"first_word": a - int(w.first[d]), "last_word": b - int(w.first[d]),
                                    "byte_start": int(w.starts[a] - w.offsets[d]),
                                    "byte_end": int(w.ends[b] - w.offsets[d])})
                for d, k in zip(docs.tolist(), found.tolist()):
                    names[d].append(p.names[k])
                spans += here
                items += names
            if again:
                old = batch.column(batch.schema.get_field_index("spans")).to_pylist()
                spans = [_merge([*a, *b]) if a and b else a or b for a, b in zip(old, spans)]
                old = batch.column(batch.schema.get_field_index("items")).to_pylist()
                items = [[*a, *b] for a, b in zip(old, items)]
            span = pa.struct([(k, pa.int64()) for k in ("first_word", "last_word", "byte_start", "byte_end")])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in carry]
            columns += [column] * keep_text
            columns += [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(span)),
                        pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))]
            names_out = [*carry, *["text"] * keep_text, "n_words", "spans", "items"]
            yield pa.RecordBatch.from_arrays(columns, names=names_out)
    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10,
                       carry: tuple[str, ...] = ("doc_id",), pass_bytes: int = PASS_BYTES) -> DataFrame:
    """For each row of ``docs``: the ``carry`` columns, n_words, the merged removal
    spans (word and UTF-8 byte ranges), the ids of the items found (as sorted
    strings) and n_hit, the number of words inside spans.

    The test set is read by its checked size: if its texts exceed ``pass_bytes``,
    they are split by item and the documents are passed once for each part, so a
    worker never holds more than one part.  No shuffle in either case."""
    spark = docs.sparkSession
    ready(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text").alias("text")) \
        .where("name is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("name"))).first()[0] or 0
    parts = int(-(-size // pass_bytes)) or 1
    frame = docs.select(*carry, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name != "text")
    for k in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == k)
        rows = [(r["name"], r["text"]) for r in part.toLocalIterator()]
        shared = spark.sparkContext.broadcast(Phrases(rows, window))
        last = k == parts - 1
        frame = frame.mapInArrow(
            _scan_batches(shared, list(carry), k > 0, not last),
            f"{kinds}, {'' if last else 'text string, '}n_words bigint, spans array<{SPAN}>, items array<string>")
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last_word"] - s["first_word"] + 1)
    return frame.withColumn("n_hit", hit)
