"""Bytes are coded down the Huffman tree of the training texts' coded bytes."""

import math

import numpy as np
import pyarrow as pa

from articlespark.llm import ctxmix as m
from articlespark.llm.words import SPACE_WORDS, iter_words

TEXTS = ["The cat  sat\non the mat the cat", None, "", "sat on é\x00z the mat " * 300, "the cat sat", "a" * 5000 + " b"]


def streams(bits):
    return [m.Stream(w, bits) for w in iter_words(pa.array(TEXTS), SPACE_WORDS, 40)]


def coded_bytes(train):
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS), pa.array(train)], names=["text", "train"])
    counts = [0] * 256
    for b in m._vocabulary(iter([batch])):
        for byte, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if byte is not None:
                counts[byte] += c
    return counts


def test_coded_bytes_are_those_of_the_training_texts():
    data = np.concatenate([s.bytes for s in streams((12,) * m.ORDERS)])
    assert coded_bytes([True] * len(TEXTS)) == np.bincount(data, minlength=256).tolist()
    some = coded_bytes([False, True, True, False, True, False])
    assert some[m.END] == 3 and some[m.BLANK] == 3 and sum(some) == 3 + 3 + len("thecatsat")


def test_every_byte_has_a_leaf_and_frequent_ones_few_decisions():
    for counts in ([0] * 256, coded_bytes([True] * len(TEXTS)), [1 << (b // 5) for b in range(256)]):
        paths = m.huffman(counts)
        assert sum(2.0 ** -len(p) for p in paths) == 1 and len({tuple(p) for p in paths}) == 256
        assert all(p[0][0] == 1 and 1 <= x <= 255 for p in paths for x, _ in p) and len({x for p in paths for x, _ in p}) == 255
        assert all(len(p) <= len(q) for p, x in zip(paths, counts) for q, y in zip(paths, counts) if x > 2 * y + max(1, sum(counts) >> 14))
    counts = coded_bytes([True] * len(TEXTS))
    paths = m.huffman(counts)
    assert sum(c * len(p) for c, p in zip(counts, paths)) < 5 * sum(counts)


def test_decisions_of_all_depths_are_counted_and_cost_what_the_weights_say():
    bits = (12, 13, 12, 14, 12)
    paths = m.huffman(coded_bytes([True] * len(TEXTS)))
    coder = m.Coder(bits, paths)
    table = np.zeros((int(m.table_offsets(bits)[-1]), 2), np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS)], names=["text"])
    for b in m._count_bits(bits, paths)(iter([batch])):
        k, part = b.column(0)[0].as_py(), np.frombuffer(b.column(1)[0].as_py(), "<u4").reshape(-1, 2)
        table[k * m.BLOCK:k * m.BLOCK + len(part)] = part
    counted = np.zeros_like(table)
    for s in streams(bits):
        for i, byte in enumerate(s.bytes):
            for node, bit in paths[byte]:
                np.add.at(counted, (s.contexts[:, i] ^ coder.nodes[node], bit), 1)
    assert (table == counted).all()
    stretched, seen = m._predictors(table)
    weights = np.random.default_rng(1).uniform(0, 0.5, (m.ORDERS, m.GATES)).astype(np.float32)
    for s in streams(bits):
        gate, lp = coder.gates(seen, s, slice(None)), np.zeros(len(s.bytes))
        for i, byte in enumerate(s.bytes):
            for node, bit in paths[byte]:
                x = float(weights[:, gate[i]] @ stretched[s.contexts[:, i] ^ coder.nodes[node]].astype(np.float32)) / m.SCALE
                x = max(-m.LIMIT, min(m.LIMIT, x))
                lp[i] -= math.log1p(math.exp(-x if bit else x))
        assert np.allclose(m.token_costs(s, coder, (stretched, seen), weights), np.add.reduceat(lp, s.starts), rtol=1e-3, atol=1e-4)
