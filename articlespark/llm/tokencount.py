"""Token counts by byte-pair merging, without producing any token.

A text is cut as the vocabulary's pre-tokenizer cuts it.  For each distinct piece a
heap holds the adjacent pairs by merge rank and a linked list holds the symbols;
the lowest-rank pair is popped and merged until none is left, and the piece counts
its initial symbols minus its merges.  Counts are kept for each blank-separated
chunk, in two generations of bounded size, so a worker's memory does not grow with
the vocabulary of its rows.

Defined results: null and empty texts have no tokens; a special token's string
inside a text counts one; repeated rows are counted one by one; a null doc_id is an
ordinary row; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ready

#: Chunks kept in each of two generations.
CACHE = 300_000
#: Bits of a symbol number.
SHIFT = 20
MASK = (1 << SHIFT) - 1
#: The byte-level pre-tokenizer's fixed pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class _Cache(dict):
    """Counts by chunk; a chunk not found is looked up in the older generation."""

    def __init__(self, count, size: int):
        super().__init__()
        self.count, self.size, self.old = count, size, {}

    def __missing__(self, chunk):
        n = self.old.get(chunk)
        if n is None:
            n = self.count(chunk)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[chunk] = n
        return n


class PairMerger:
    """Counts tokens as a byte-level BPE vocabulary file for the tokenizers library does."""

    def __init__(self, spec: dict, cache: int = CACHE):
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" \
                or spec["pre_tokenizer"].get("add_prefix_space") or spec["model"].get("ignore_merges"):
            raise ValueError("a byte-level BPE vocabulary without normalizer or prefix space is expected")
        letters = byte_letters()
        number: dict[str, int] = {}
        self.byte = [number.setdefault(c, len(number)) for c in letters]
        self.pairs: dict[int, int] = {}  # left << SHIFT | right -> rank << SHIFT | merged symbol
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = (number.setdefault(x, len(number)) for x in (a, b))
            self.pairs.setdefault(left << SHIFT | right, rank << SHIFT | number.setdefault(a + b, len(number)))
        if len(number) >= 1 << SHIFT:
            raise ValueError("too many symbols")
        self.first = [self.pairs.get(a << SHIFT | b, -1) for a in self.byte for b in self.byte]  # by two bytes
        special = [t["content"] for t in spec.get("added_tokens", [])]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        special.sort(key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marks = special
        self.pattern = regex.compile(PATTERN)
        self.pieces = _Cache(self.count_piece, cache)
        self.chunks = _Cache(self.count_chunk, cache)
        self.odd_blank = regex.compile(r"\s ")

    def count_piece(self, piece: str) -> int:
        """Initial symbols minus merges."""
        data = piece.encode("utf-8", "surrogatepass")
        n, first, find = len(data), self.first, self.pairs.get
        hits = [first[a << 8 | b] for a, b in zip(data, data[1:])]  # the merge at each symbol, -1 if none
        heap = [(h >> SHIFT) * n + i for i, h in enumerate(hits) if h >= 0]
        if not heap:
            return n
        heapify(heap)
        hits.append(-1)
        byte = self.byte
        symbol = [byte[b] for b in data]
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            rank, i = divmod(heappop(heap), n)
            h = hits[i]
            if h >> SHIFT != rank:
                continue  # one of the two has been merged since
            j = after[i]
            s = symbol[i] = h & MASK
            hits[j] = -1
            left -= 1
            k = after[i] = after[j]
            h = -1
            if k < n:
                before[k] = i
                h = find(s << SHIFT | symbol[k], -1)
                if h >= 0:
                    heappush(heap, (h >> SHIFT) * n + i)
            hits[i] = h
            k = before[i]
            if k >= 0:
                h = hits[k] = find(symbol[k] << SHIFT | s, -1)
                if h >= 0:
                    heappush(heap, (h >> SHIFT) * n + k)
        return left

    def count_chunk(self, chunk: str) -> int:
        return sum(map(self.pieces.__getitem__, self.pattern.findall(chunk)))

    def count_plain(self, text: str) -> int:
        """A text without special tokens.  A blank after a non-blank always begins a
        piece, so chunks between such blanks count on their own; where blanks follow
        white space the text is cut whole."""
        if not text:
            return 0
        if self.odd_blank.search(text) or text[0] == " " or text[-1] == " ":
            return self.count_chunk(text)
        first, *rest = text.split(" ")
        return self.chunks[first] + sum(map(self.chunks.__getitem__, [" " + x for x in rest]))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not any(m in text for m in self.marks):
            return self.count_plain(text)
        plain = self.special.split(text)
        return sum(map(self.count_plain, plain)) + len(plain) - 1


@lru_cache(maxsize=2)
def _merger(content: str) -> PairMerger:
    return PairMerger(json.loads(content))


def _count(content):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(content.value)  # kept by the worker for its next tasks
        for batch in batches:
            texts = batch.column(1)
            n_bytes = [0 if not t.is_valid else t.as_buffer().size for t in texts]
            counts = [merger.count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row.  ``vocabulary`` is the path, on the
    driver, of a tokenizers JSON file; its content (its size is fixed) is broadcast."""
    spark = docs.sparkSession
    ready(spark)
    with open(vocabulary, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_count(content), f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
