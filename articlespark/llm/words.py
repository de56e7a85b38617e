"""Vectorised word scanning over Arrow string columns.

``iter_words`` cuts whole texts into words straight from the Arrow buffers (no
Python string per word) and gives each word a 64-bit hash.  Work goes over
chunks of whole documents, so memory is bounded by the chunk size or by the
longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEP = 32
_PRIME = np.uint64(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2**64
_HASH_STEP = 1 << 18


def _lut(is_sep) -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    for b in range(256):
        if is_sep(b):
            out[b] = SEP
    return out


#: Words are runs of anything but ASCII white space.
SPACE_WORDS = _lut(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
#: Words are runs of ASCII letters, digits and everything beyond ASCII.
ALNUM_WORDS = _lut(lambda b: b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _HASH_STEP + 4096)
        inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
        tables = []
        for base in (_PRIME, inverse):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            np.multiply.accumulate(t, out=t)
            tables.append(t)
        _powers[:] = tables
    return _powers[0], _powers[1]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range ``data[starts:ends]`` (ranges in order)."""
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + _HASH_STEP, side="right")))
        size = int(ends[hi - 1]) - base
        power, inverse = _power_tables(size + 1)
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[data[base:base + size]] * power[:size], out=total[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mix64((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def hash_prefixes(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit value, for each byte, of its range's bytes before it; the ranges, in order,
    cover ``data``.  Equal beginnings of ranges have equal values wherever they are."""
    out = np.empty(len(data), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(starts, base + _HASH_STEP, side="right")) - 1)
        end = int(starts[hi - 1] + size[hi - 1])
        power, inverse = _power_tables(end - base + 1)
        total = np.zeros(end - base + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[data[base:end]] * power[:end - base], out=total[1:])
        s = starts[lo:hi] - base
        out[base:end] = (total[:-1] - np.repeat(total[s], size[lo:hi])) * np.repeat(inverse[s], size[lo:hi])
        lo = hi
    return out


def hash_bytes(word: bytes) -> int:
    """The same hash for one word that is already in lower case."""
    data = np.frombuffer(word, dtype=np.uint8)
    return int(hash_words(data, np.array([0]), np.array([len(word)]))[0])


@dataclass
class Words:
    """Words of the documents ``lo..hi-1`` of a column."""

    lo: int
    hi: int
    data: np.ndarray    # the documents' bytes, lower-cased, separators as blanks
    base: int           # offset of data[0] within the column's bytes
    offsets: np.ndarray  # byte offsets of the documents within data, hi - lo + 1 of them
    starts: np.ndarray  # byte ranges of the words within data
    ends: np.ndarray
    first: np.ndarray   # index of each document's first word, hi - lo + 1 of them

    def hashes(self) -> np.ndarray:
        return hash_words(self.data, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts())


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, offsets


def iter_words(column: pa.Array, lut: np.ndarray, max_bytes: int = 1 << 21) -> Iterator[Words]:
    """Words of every row, in chunks of whole rows of about ``max_bytes``.
    Null and empty rows have no words; no row is cut."""
    raw, offsets = column_bytes(column)
    n, lo = len(column), 0
    while lo < n:
        base = int(offsets[lo])
        hi = max(lo + 1, int(np.searchsorted(offsets, base + max_bytes, side="right")) - 1)
        data = lut[raw[base:int(offsets[hi])]]
        offs = offsets[lo:hi + 1] - base
        inside = data != SEP
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        heads = offs[:-1][offs[:-1] < offs[1:]]
        begin[heads] = inside[heads]
        tails = offs[1:][offs[:-1] < offs[1:]] - 1
        end[tails] = inside[tails]
        starts = np.flatnonzero(begin)
        yield Words(lo, hi, data, base, offs, starts, np.flatnonzero(end) + 1,
                    np.searchsorted(starts, offs))
        lo = hi
