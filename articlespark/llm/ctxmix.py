"""Language-model scores by logistic context mixing of bit predictors over the running text.

A text is coded as its tokens: each word's bytes (A-Z in lower case) and a blank, then one
end mark, every byte as binary decisions down a tree, every occurrence of every word.  The
tree is the Huffman code of the training texts' coded bytes: it has a leaf for each of the
256 bytes, and frequent ones take few decisions.  Five predictors look up hashed contexts in tables of bit counts that are summed over all training
texts: the last two, three and five bytes (across blanks), the word so far, and the word so
far with the word before it.  Their stretched probabilities are combined by weights that a
gate selects (how often the last five bytes, and the word pair so far, were seen); the
weights are learned online in text order, each byte being predicted as if it had not been
counted, and averaged over the tasks.

A last stage adapts to the document: experts mix a token's coded probability with its
discounted training frequency and with its share of the tokens before it in the document,
the latter by a gate that follows the document's rate of repeats so far.  The experts
(``EXPERTS``) have equal weights at first and are followed by their success in the document.
All are probabilities of the token after those before it, so the total is the text's log10
probability under one model; ``bits_per_byte`` spreads it over the coded bytes.

Tables grow with the training text up to ``TABLE_BITS``; beyond that contexts share slots.
Words that occur most are broadcast (``HELD_WORDS`` at most); the occurrences of all others
are joined with the word table, so every token has its exact frequency.

Defined results: null and empty texts are one end mark; a null doc_id is neither held
out nor learned from; without training documents every count is 0 and the tables are
empty, and scores stay finite; no probability has a floor; repeated rows are scored one by
one; other columns are ignored.  ``docs`` must be a stable scan.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, ready, written
from .words import SPACE_WORDS, Words, hash_prefixes, iter_words, mix64

#: Largest tables, as powers of two: the last 2, 3, 5 bytes, the word so far, the pair so far.
TABLE_BITS = (18, 20, 20, 20, 21)
ORDERS, CLASSES = len(TABLE_BITS), 8
GATES = CLASSES * CLASSES
HELD_WORDS = 300_000
#: Text bytes a task counts or learns from, about: its tables are shuffled.
TASK_BYTES = 64 << 20
BLOCK = 1 << 15
SEGMENT = 1 << 12
#: Text bytes that are worked on at once, and bytes of which equal ones are counted at once.
CHUNK, COUNTED = 1 << 17, 1 << 21
#: Nodes of the tree whose slots lie together.
TOGETHER = 16
RATE, FIRM, START_WEIGHT, PRIOR = 0.05, 100.0, 0.3, 0.05
#: Stretched probabilities are kept in steps of 1 / SCALE.
SCALE, LIMIT = 14.0, 11.0
#: Of each of a document's experts: how strongly it trusts repeats, and the frequency.
EXPERTS = ((0.0, 0.05), (0.0, 0.5), (0.0, 0.95), (0.15, 0.3), (0.4, 0.3), (0.4, 0.8), (0.8, 0.5))
BLANK, END = 32, 10
_SALTS = mix64(np.arange(1, ORDERS + 1, dtype=np.uint64)) | np.uint64(1)
_NODES = mix64(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

#: Of each word (byte is null) its hash and its occurrences, in training texts and in all; of each coded byte its occurrences in training texts.
VOCABULARY = "byte int, h bigint, c bigint, n bigint"


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coded = np.zeros(256, dtype=np.int64)
    for batch in batches:
        train = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for w in iter_words(batch.column(0), SPACE_WORDS, 1 << 23):
            h = w.hashes()
            learnt = train[w.lo:w.hi] > 0
            here = np.bincount(w.data[np.repeat(learnt, np.diff(w.offsets))], minlength=256)
            here[BLANK], here[END] = w.counts()[learnt].sum(), learnt.sum()
            coded += here
            order = np.argsort(h)
            sorted_h = h[order]
            new = np.ones(len(h), dtype=bool)
            np.not_equal(sorted_h[1:], sorted_h[:-1], out=new[1:])
            start = np.flatnonzero(new)
            if not len(start):
                continue
            learned = np.add.reduceat(np.repeat(train[w.lo:w.hi], w.counts())[order], start)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(start), pa.int32()), pa.array(sorted_h[start].view(np.int64)), pa.array(learned),
                 pa.array(np.diff(np.append(start, len(h))))], names=["byte", "h", "c", "n"])
    some = np.flatnonzero(coded)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.nulls(len(some), pa.int64()), pa.array(coded[some]), pa.array(coded[some])],
                                     names=["byte", "h", "c", "n"])


def huffman(counts) -> list[list[tuple[int, int]]]:
    """Of each of 256 bytes its decisions, as (node, decision) from the root down.  Nodes are
    numbered from 1 by falling weight; bytes that are rare or missing keep a small weight."""
    least = max(1, int(sum(counts)) >> 14)
    heap = [(int(c) + least, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    parent = {}
    for node in range(256, 511):  # lighter ones are made first
        weight = 0
        for bit in (0, 1):
            w, child = heapq.heappop(heap)
            parent[child], weight = (node, bit), weight + w
        heapq.heappush(heap, (weight, node))
    paths = []
    for at in range(256):
        path = []
        while at in parent:
            at, bit = parent[at]
            path.append((511 - at, bit))
        paths.append(path[::-1])
    return paths


def eight_bits() -> list[list[tuple[int, int]]]:
    """The tree of a byte's bits from the highest down."""
    return [[((256 + b) >> (8 - t), (b >> (7 - t)) & 1) for t in range(8)] for b in range(256)]


def table_bits(train_bytes: int) -> tuple[int, ...]:
    return tuple(min(b, max(12, int(train_bytes).bit_length() + 1)) for b in TABLE_BITS)


def table_offsets(bits: tuple[int, ...]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([1 << b for b in bits])])


class Stream:
    """The coded bytes of some documents and the contexts of each, as slots of the tables in
    a row.  Its tokens (words and end marks, in text order) start at ``starts``; ``words`` are
    the hashes of its words."""

    def __init__(self, w: Words, bits: tuple[int, ...]):
        ends_at = w.first[1:]
        starts = np.insert(w.starts, ends_at, 0)
        size = np.insert(w.ends - w.starts, ends_at, 0) + 1
        after = np.cumsum(size)
        self.size, self.starts, total = size, after - size, int(after[-1])
        self.is_end = np.zeros(len(size), dtype=bool)
        self.is_end[ends_at + np.arange(len(ends_at))] = True
        source = np.repeat(starts - self.starts, size)
        source += np.arange(total)
        data = np.append(w.data, np.uint8(BLANK))
        self.bytes = data.take(source, mode="clip")
        self.bytes[after - 1] = np.where(self.is_end, np.uint8(END), np.uint8(BLANK))
        heads = np.append(0, after[self.is_end][:-1])
        # Bytes before a document's first one are end marks.
        sums, past = {}, np.zeros(total, dtype=np.uint64)
        for k in range(1, 6):
            x = np.full(total, END, dtype=np.uint8)
            x[k:] = self.bytes[:-k]
            for j in range(k):
                at = heads + j
                x[at[at < total]] = END
            past <<= np.uint64(8)
            past |= x
            sums[k] = past.copy() if k in (2, 3, 5) else None
        self.words = w.hashes()
        token = np.zeros(len(size), dtype=np.uint64)
        token[~self.is_end] = self.words
        before = np.append(np.uint64(0), token[:-1])  # an end mark's is 0, and so is that before a first word
        so_far = hash_prefixes(self.bytes, self.starts, size)
        pair = so_far + np.repeat(mix64(before + np.uint64(7)), size)
        self.contexts = np.empty((ORDERS, total), dtype=np.int64)
        for out, x, salt, b, offset in zip(self.contexts, (sums[2], sums[3], sums[5], so_far, pair), _SALTS, bits, table_offsets(bits)):
            x ^= x >> np.uint64(29)
            x *= salt
            x >>= np.uint64(64 - b)
            np.add(x.view(np.int64), offset, out=out)

    def segments(self) -> Iterator[slice]:
        for lo in range(0, len(self.bytes), SEGMENT):
            yield slice(lo, lo + SEGMENT)


class Coder:
    """Slots of decisions.  A byte's ``paths`` (see ``huffman``) name its nodes; a node moves a
    context's slot within a block as large as the smallest table, and nodes of like weight lie
    together."""

    def __init__(self, bits: tuple[int, ...], paths=None):
        paths = eight_bits() if paths is None else paths
        node = np.arange(256)
        self.nodes = ((_NODES[node // TOGETHER] >> np.uint64(64 - min(bits))).astype(np.int64) & -TOGETHER) | (node % TOGETHER)
        self.depth = np.array([len(p) for p in paths])
        self.node, self.bit = np.zeros((2, max(self.depth), 256), dtype=np.int64)
        for b, path in enumerate(paths):
            for t, (x, bit) in enumerate(path):
                self.node[t, b], self.bit[t, b] = self.nodes[x], bit
        self.height = (self.depth.max() - self.depth).astype(np.uint8)
        # Twice the slot, plus the decision taken.
        self.taken = 2 * self.node + self.bit
        self.bit = self.bit.astype(np.float32)

    def decisions(self, stream: Stream, part: slice, taken: bool = False):
        """All decisions of the part's bytes: first those of all bytes, then the second ones of
        the bytes that have any, and so on.  (positions of the bytes, deepest first; places
        where the first, second ... decisions end; decisions; their slots of each order; with
        ``taken``, twice the slot plus the decision)."""
        byte = stream.bytes[part]
        order = np.argsort(self.height.take(byte), kind="stable")
        byte = byte.take(order).astype(np.int64)
        order += part.indices(len(stream.bytes))[0]
        contexts = stream.contexts.take(order, axis=1)
        if taken:
            contexts <<= 1
        fewer = np.cumsum(np.bincount(self.depth.take(byte), minlength=len(self.node) + 1))[:len(self.node)]
        sizes = len(byte) - fewer
        ends = np.cumsum(sizes[sizes > 0])
        bit, slots = np.empty(ends[-1], dtype=np.float32), np.empty((ORDERS, ends[-1]), dtype=np.int64)
        nodes, lo = self.taken if taken else self.node, 0
        for t, hi in enumerate(ends):
            here = byte[:hi - lo]
            np.bitwise_xor(contexts[:, :hi - lo], nodes[t].take(here), out=slots[:, lo:hi])
            self.bit[t].take(here, out=bit[lo:hi], mode="clip")
            lo = hi
        return order, ends, bit, slots

    def steps(self, stream: Stream, part: slice):
        """(decision, slots of each order) for the first, second ... decisions of the bytes that
        have them, the deepest bytes first."""
        _, ends, bit, slots = self.decisions(stream, part)
        for lo, hi in zip(np.append(0, ends[:-1]), ends):
            yield bit[lo:hi].astype(np.int64), slots[:, lo:hi]

    def keys(self, stream: Stream) -> np.ndarray:
        """Context and byte in one number, for each order."""
        return (stream.contexts << 8) | stream.bytes

    def count(self, keys: list[np.ndarray], counts: np.ndarray) -> None:
        """Adds the decisions of bytes in contexts; equal ones are added at once."""
        for k in range(ORDERS):
            key = np.concatenate([x[k] for x in keys])
            key.sort()
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            times = np.diff(np.append(start, len(key))).astype(np.uint32)
            key = key[start]
            order = np.argsort(self.height.take(key & 255), kind="stable")
            key, times = key.take(order), times.take(order)
            twice, byte = (key >> 8) << 1, key & 255
            sizes = len(byte) - np.cumsum(np.bincount(self.depth.take(byte), minlength=len(self.node) + 1))
            for t, n in enumerate(sizes[sizes > 0]):
                np.add.at(counts, twice[:n] ^ self.taken[t].take(byte[:n]), times[:n])

    def gates(self, seen: np.ndarray, stream: Stream, part: slice) -> np.ndarray:
        five, pair = (seen.take(stream.contexts[k][part] ^ self.nodes[1]) for k in (2, 4))
        return five + CLASSES * pair.astype(np.int64)


def _count_bits(bits: tuple[int, ...], paths=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, coder, some = np.zeros(2 * int(table_offsets(bits)[-1]), dtype=np.uint32), Coder(bits, paths), False
        keys: list[np.ndarray] = []
        for batch in batches:
            for w in iter_words(batch.column(0), SPACE_WORDS, CHUNK):
                some = True
                keys.append(coder.keys(Stream(w, bits)))
                if sum(x.shape[1] for x in keys) >= COUNTED:
                    coder.count(keys, table)
                    keys.clear()
        if some:
            if keys:
                coder.count(keys, table)
            for k in range(0, len(table), 2 * BLOCK):
                part = table[k:k + 2 * BLOCK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k // (2 * BLOCK)], pa.int32()), pa.array([part.astype("<u4").tobytes()], pa.binary())],
                                                     names=["block", "counts"])
    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, total = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.astype("<f4").tobytes()], pa.binary())],
                                          names=["block", "counts"])

    for batch in batches:
        for b, x in zip(*(c.to_pylist() for c in batch.columns)):
            if b != block and block is not None:
                yield row()
                total = None
            block = b
            part = np.frombuffer(x, "<u4").astype(np.float64)
            total = part if total is None else total + part
    if block is not None:
        yield row()


def _predictors(table: np.ndarray, without_one: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Of each slot, the stretched probability of a 1, in steps of 1 / SCALE, and its share
    of the gate; with ``without_one``, of each slot and decision, as if that decision had
    been counted once less."""
    stretched = np.empty(table.shape if without_one else len(table), dtype=np.int8)
    seen = np.empty(len(table), dtype=np.int8)
    for lo in range(0, len(table), 8 * BLOCK):
        part = slice(lo, lo + 8 * BLOCK)
        n0, n1 = table[part, 0], table[part, 1]
        seen[part] = np.minimum(np.log2(1 + np.maximum(n0 + n1 - without_one, 0)), CLASSES - 1)
        if without_one:
            stretched[part, 0], stretched[part, 1] = _stretch(np.maximum(n0 - 1, 0), n1), _stretch(n0, np.maximum(n1 - 1, 0))
        else:
            stretched[part] = _stretch(n0, n1)
    return stretched.ravel(), seen


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(SCALE * np.log((n1 + np.float32(PRIOR)) / (n0 + np.float32(PRIOR)))), -127, 127)


def _learn_weights(ref, bits: tuple[int, ...], paths=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (stretched, seen), coder = ref.value, Coder(bits, paths)
        weights = np.full((ORDERS, GATES), START_WEIGHT / SCALE)
        total, mean, moved = np.zeros(GATES), np.zeros((ORDERS, GATES)), np.full((ORDERS, GATES), FIRM)
        for batch in batches:
            for w in iter_words(batch.column(0), SPACE_WORDS, CHUNK):
                stream = Stream(w, bits)
                for part in stream.segments():
                    order, ends, bit, slots = coder.decisions(stream, part, True)
                    gate = coder.gates(seen, stream, order)
                    own = weights.astype(np.float32).take(gate, axis=1)
                    x = _looked_up(stretched, slots)
                    bit -= _probability(_total(_times(x, own, ends, np.empty_like(x))))
                    x *= bit
                    pull = _by_byte(x, ends)
                    share = np.bincount(gate, minlength=GATES)
                    for k in range(ORDERS):
                        step = np.bincount(gate, pull[k], GATES) / SCALE
                        moved[k] += step * step
                        weights[k] += RATE / SCALE * step / np.sqrt(moved[k])
                    total += share
                    mean += weights * share
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.tile(np.arange(GATES), ORDERS)), pa.array(np.repeat(np.arange(ORDERS), GATES)),
             pa.array(mean.ravel() * SCALE), pa.array(np.tile(total, ORDERS))], names=["gate", "k", "w", "seen"])
    return run


def _looked_up(stretched: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return stretched.take(slots, out=np.empty(slots.shape, dtype=np.int8), mode="wrap").astype(np.float32)


def _times(x: np.ndarray, own: np.ndarray, ends: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Each decision's values times its byte's weights."""
    lo = 0
    for hi in ends:
        np.multiply(x[:, lo:hi], own[:, :hi - lo], out=out[:, lo:hi])
        lo = hi
    return out


def _by_byte(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of each byte's decisions."""
    total = x[..., :ends[0]]
    for lo, hi in zip(ends, ends[1:]):
        total[..., :hi - lo] += x[..., lo:hi]
    return total


def _total(st: np.ndarray) -> np.ndarray:
    x = st[0]
    for y in st[1:]:
        x += y
    return x


def _probability(x: np.ndarray) -> np.ndarray:
    np.clip(x, -LIMIT, LIMIT, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def token_costs(stream: Stream, coder: Coder, predictors, weights: np.ndarray) -> np.ndarray:
    """Natural log of the coded probability of each token."""
    stretched, seen = predictors
    weights = (weights / SCALE).astype(np.float32)
    cost = np.empty(len(stream.bytes))
    for part in stream.segments():
        order, ends, bit, slots = coder.decisions(stream, part)
        own = weights.take(coder.gates(seen, stream, order), axis=1)
        st = _looked_up(stretched, slots)
        x = _total(_times(st, own, ends, st))
        np.clip(x, -LIMIT, LIMIT, out=x)
        bit *= -2
        bit += 1
        x *= bit
        np.exp(x, out=x)
        x += 1
        np.log(x, out=x)
        cost[order] = -_by_byte(x, ends)
    return np.add.reduceat(cost, stream.starts)


class Scorer:
    """What a document needs: the tables, the held words' counts, and totals."""

    def __init__(self, h, c, train: int, ends: int, distinct: int, discount: float, predictors, weights, bits, paths):
        order = np.argsort(h.view(np.uint64))
        self.h, self.c = h.view(np.uint64)[order], c[order]
        self.train, self.ends, self.distinct, self.discount = train, ends, distinct, discount
        self.predictors, self.weights, self.bits, self.paths = predictors, weights, bits, paths

    def base(self, c):
        return np.log10((c + 0.1) / (self.train + 0.1 * (self.distinct + 1)))

    def frequency(self, c):
        return np.maximum(c - self.discount, 0) / max(1, self.train)


def _score(ref):
    rest_type = pa.list_(pa.struct([("h", pa.int64()), ("gate", pa.float64()), ("again", pa.float64()), ("lp", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Scorer = ref.value
        coder = Coder(s.bits, s.paths)
        for batch in batches:
            for w in iter_words(batch.column(1), SPACE_WORDS, CHUNK):
                stream = Stream(w, s.bits)
                coded = token_costs(stream, coder, s.predictors, s.weights)
                h, count, first = stream.words, w.counts(), w.first
                doc = w.doc_of_word()
                docs, n = w.hi - w.lo, len(h)
                spot = np.minimum(np.searchsorted(s.h, h), max(0, len(s.h) - 1))
                held = s.h[spot] == h if len(s.h) else np.zeros(n, bool)
                c = np.where(held, s.c[spot], 0) if len(s.h) else np.zeros(n)
                # Occurrences of the same word before, in the document.
                order = np.lexsort((h, doc))
                new = np.ones(n, dtype=bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                start = np.flatnonzero(new)
                rank = np.empty(n)
                rank[order] = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
                place = np.arange(n) - first[:-1][doc]
                repeats = np.cumsum(rank > 0) - (rank > 0)
                repeats = repeats - repeats[first[:-1][doc]] if n else repeats
                gate = np.where(place > 0, (repeats + 0.5) / (place + 1), 0)
                again = rank / np.maximum(place, 1)
                # An end mark repeats nothing, but its gate is open like a word's.
                lp, end_lp = coded[~stream.is_end], coded[stream.is_end]
                known = np.bincount(doc, rank > 0, docs)
                end_gate = np.where(count > 0, (known + 0.5) / (count + 1), 0)
                known_share, end_share = s.frequency(c), s.frequency(np.float64(s.ends))
                scores = [np.bincount(doc, np.where(held, expert(g, f, gate, again, known_share, lp), 0), docs)
                          + expert(g, f, end_gate, 0.0, end_share, end_lp) for g, f in EXPERTS]
                base = np.where(held, s.base(c), 0)
                rest = np.flatnonzero(~held)
                cut = np.searchsorted(rest, first)
                items = pa.StructArray.from_arrays(
                    [pa.array(h[rest].view(np.int64)), pa.array(gate[rest]), pa.array(again[rest]), pa.array(lp[rest])],
                    names=["h", "gate", "again", "lp"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.lo, docs), batch.column(2).slice(w.lo, docs), pa.array(count + 1),
                     pa.array(np.bincount(np.cumsum(stream.is_end) - stream.is_end, stream.size, docs).astype(np.int64)),
                     pa.array(np.bincount(doc, held & (c > 0), docs).astype(np.int64) + int(s.ends > 0)),
                     pa.array(np.bincount(doc, base, docs) + s.base(s.ends)), pa.array(np.stack(scores, axis=1).tolist(), pa.list_(pa.float64())),
                     pa.ListArray.from_arrays(pa.array(cut, pa.int32()), items).cast(rest_type)],
                    names=["rid", "doc_id", "n_tokens", "n_bytes", "n_known", "base_score", "scores", "rest"])
    return run


def expert(g: float, f: float, gate, again, share, lp):
    """Natural log of the probability an expert gives a token: coded, repeated or by frequency."""
    plain = (1 - f) * (1 - g * gate)
    other = f * (1 - g * gate) * share + g * gate * again
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(plain) + lp, np.log(other))


def _expert_column(g: float, f: float, share):
    """The same over columns gate, again and lp."""
    kept = 1 - g * F.col("gate")
    coded = F.ln((1 - f) * kept) + F.col("lp")
    other = f * kept * share + g * F.col("gate") * F.col("again")
    return F.when(other > 0, F.greatest(coded, F.ln(other)) + F.log1p(F.exp(-F.abs(coded - F.ln(other))))).otherwise(coded)


def score_documents(docs: DataFrame, row_id: str, held_words: int = HELD_WORDS) -> DataFrame:
    """(row_id, doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte) for each row of ``docs`` (``row_id``, doc_id, text)."""
    spark = docs.sparkSession
    ready(spark)
    train = F.coalesce(crc_mod("doc_id", 10) != 0, F.lit(False))
    found = written(docs.select("text", train.alias("train")).mapInArrow(_vocabulary, VOCABULARY)
                    .groupBy("byte", "h").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "lm-words")
    words = found.where(F.col("byte").isNull()).drop("byte")
    coded = [0] * 256
    for r in found.where(F.col("byte").isNotNull()).collect():  # 256 rows at most
        coded[r["byte"]] = r["c"]
    paths = huffman(coded)
    ends, size = docs.where(train).agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    distinct, tokens, rows, once, twice = words.agg(
        F.count_if(F.col("c") > 0), F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    discount = min(0.9, max(0.1, once / max(1, once + 2 * twice)))  # taken off every count
    bits = table_bits(size or 0)
    offsets = table_offsets(bits)
    learnt = docs.where(train).select("text")
    learnt = learnt.coalesce(max(1, -(-(size or 0) // TASK_BYTES)))
    blocks = learnt.mapInArrow(_count_bits(bits, paths), "block int, counts binary").repartition("block").sortWithinPartitions("block") \
        .mapInArrow(_sum_blocks, "block int, counts binary")
    table = np.zeros((int(offsets[-1]), 2), dtype=np.float32)
    for r in blocks.toLocalIterator():  # one row a block: the size of the tables at most
        part = np.frombuffer(r["counts"], "<f4").reshape(-1, 2)
        table[r["block"] * BLOCK:r["block"] * BLOCK + len(part)] = part
    less = spark.sparkContext.broadcast(_predictors(table, True))
    plain = _predictors(table)
    del table
    learned = learnt.mapInArrow(_learn_weights(less, bits, paths), "gate bigint, k bigint, w double, seen double") \
        .groupBy("gate", "k").agg((F.sum("w") / F.greatest(F.sum("seen"), F.lit(1e-9))).alias("w"), F.sum("seen").alias("seen")).collect()
    less.unpersist()
    weights = np.full((ORDERS, GATES), START_WEIGHT, dtype=np.float32)
    for r in learned:
        if r["seen"] > 0:
            weights[r["k"], r["gate"]] = r["w"]
    # The most frequent words, as many whole frequency classes as the bound holds.
    least = 0
    if rows > held_words:
        classes = words.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(held_words).toPandas()
        fit = classes["n"][classes["k"].cumsum() <= held_words]
        least = int(fit.min()) if len(fit) else 1 << 62
    top = words.where(F.col("n") >= least).select("h", "c").toPandas()
    scorer = Scorer(top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64), (tokens or 0) + ends, ends,
                    (distinct or 0) + int(ends > 0), discount, plain, weights, bits, paths)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = written(docs.select(F.col(row_id).alias("rid"), "text", "doc_id").mapInArrow(
        _score(spark.sparkContext.broadcast(scorer)),
        f"rid bigint, doc_id {kind}, n_tokens bigint, n_bytes bigint, n_known bigint, base_score double, scores array<double>, "
        "rest array<struct<h:bigint,gate:double,again:double,lp:double>>"), "lm-scored")
    rest = scored.select("rid", F.explode("rest").alias("x")).select("rid", "x.*").join(words.where(F.col("n") < least).drop("n"), "h")
    spread = float(scorer.train + 0.1 * (scorer.distinct + 1))
    share = F.greatest(F.col("c") - discount, F.lit(0.0)) / float(max(1, scorer.train))
    rest = rest.groupBy("rid").agg(
        F.sum(F.log10((F.col("c") + 0.1) / spread)).alias("rest_base"), F.count_if(F.col("c") > 0).alias("rest_known"),
        F.array(*(F.sum(_expert_column(g, f, share)) for g, f in EXPERTS)).alias("rest_scores"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    each = F.zip_with("scores", F.coalesce("rest_scores", F.array(*[F.lit(0.0)] * len(EXPERTS))), lambda a, b: a + b)
    best = F.array_max("each")
    score = (best + F.ln(F.aggregate("each", F.lit(0.0), lambda t, x: t + F.exp(x - best)) / len(EXPERTS))) / math.log(10)
    return scored.drop("rest").join(rest, "rid", "left").withColumn("each", each).select(
        F.col("rid").alias(row_id), "doc_id", F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("n_known") + zero("rest_known")).alias("n_known"), F.lit(scorer.train).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + zero("rest_base")).alias("base_score"), score.alias("score"),
        (-score / math.log10(2) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
