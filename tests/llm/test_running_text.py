"""The language model codes every occurrence of the running text."""

import math
import random

import numpy as np
import pyarrow as pa

from articlespark.llm import ctxmix as m
from articlespark.llm.common import crc_mod, row_ids
from articlespark.llm.words import SPACE_WORDS, iter_words

TEXTS = ["The cat  sat\non the mat the cat", None, "", "x", " \t ", "sat on é\x00z the mat", "the cat sat", "a" * 300 + " b"]


def streams(texts, bits):
    return [m.Stream(w, bits) for w in iter_words(pa.array(texts), SPACE_WORDS, 40)]


def plain(text):
    """(bytes, contexts of each) of a text, coded byte by byte."""
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w).encode() for w in (text or "").split()]
    data, contexts, before = b"", [], b""
    for w in [*words, None]:
        token = b"\n" if w is None else w + b" "
        for j in range(len(token)):
            past = b"\n" * 5 + data
            contexts.append((past[-2:], past[-3:], past[-5:], token[:j], (before, token[:j])))
            data += token[j:j + 1]
        before = w or b""
    return data, contexts


def test_contexts_are_those_of_the_running_text():
    want = [plain(t) for t in TEXTS]
    parts = streams(TEXTS, (44,) * m.ORDERS)
    offsets = m.table_offsets((44,) * m.ORDERS)
    assert b"".join(p.bytes.tobytes() for p in parts) == b"".join(d for d, _ in want)
    for k in range(m.ORDERS):
        slots = (np.concatenate([p.contexts[k] for p in parts]) - offsets[k]).tolist()
        assert 0 <= min(slots) and max(slots) < 1 << 44
        names = [c[k] for _, cs in want for c in cs]
        assert len(set(zip(slots, names))) == len(set(slots)) == len(set(names))


def test_bits_of_every_occurrence_are_counted_and_cost_what_the_weights_say():
    bits = (12, 13, 12, 14, 12)
    table = np.zeros((int(m.table_offsets(bits)[-1]), 2), np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS * 3)], names=["text"])
    for b in m._count_bits(bits)(iter([batch])):
        k, part = b.column(0)[0].as_py(), np.frombuffer(b.column(1)[0].as_py(), "<u4").reshape(-1, 2)
        table[k * m.BLOCK:k * m.BLOCK + len(part)] = part
    coder = m.Coder(bits)
    counted = np.zeros_like(table)
    for s in streams(TEXTS * 3, bits):
        for part in s.segments():
            for bit, slots in coder.steps(s, part):
                for x in slots:
                    np.add.at(counted, (x, bit), 1)
    assert (table == counted).all() and table.sum() == 3 * 8 * m.ORDERS * sum(len(plain(t)[0]) for t in TEXTS)
    stretched, seen = m._predictors(table)
    weights = np.random.default_rng(1).uniform(0, 0.5, (m.ORDERS, m.GATES)).astype(np.float32)
    for s in streams(TEXTS, bits):
        got, lp = m.token_costs(s, coder, (stretched, seen), weights), np.zeros(len(s.bytes))
        gate = coder.gates(seen, s, slice(None))
        for bit, slots in coder.steps(s, slice(None)):
            for i in range(len(bit)):
                x = sum(float(weights[k, gate[i]]) * float(stretched[slots[k][i]]) for k in range(m.ORDERS)) / m.SCALE
                x = max(-m.LIMIT, min(m.LIMIT, x))
                lp[i] -= math.log1p(math.exp(-x if bit[i] else x))
        assert np.allclose(got, np.add.reduceat(lp, s.starts), rtol=1e-4)


def test_experts_agree_in_tasks_and_in_sql(spark):
    rows = [(0.0, 0.0, -3.0, 0.0), (0.4, 0.0, -2000.0, 0.0), (0.4, 0.3, -5.0, 0.01), (0.9, 0.0, -900.0, 0.5)]
    df = spark.createDataFrame(rows, "gate double, again double, lp double, share double")
    for g, f in m.EXPERTS:
        got = [r[0] for r in df.select(m._expert_column(g, f, df["share"])).collect()]
        assert np.allclose(got, [m.expert(g, f, *r[:2], r[3], r[2]) for r in rows], rtol=1e-12)


def test_order_of_words_and_long_new_words_count(spark, tmp_path):
    rng = random.Random(3)
    names = [f"w{k}{'xyz'[k % 3] * (k % 4)}" for k in range(40)]
    places = [[rng.randrange(39) for _ in range(12)] for _ in range(300)]
    rows = [(i, " ".join(f"{names[j]} {names[j + 1]}" for j in js)) for i, js in enumerate(places)]
    held = [r[0] for r in spark.range(1000, 1100).where(crc_mod("id", 10) == 0).collect()][:4]
    once = names[10:20]
    mixed = once[::2] + once[1::2]
    long = "".join(rng.choice("abcdefgh") for _ in range(3000))
    rows += [(held[0], " ".join(once)), (held[1], " ".join(mixed)), (held[2], long), (held[3], None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/docs")
    docs = row_ids(spark.read.parquet(f"{tmp_path}/docs"), "number")
    got = {r.doc_id: r for r in m.score_documents(docs, "number").collect()}
    assert got[held[0]].base_score == got[held[1]].base_score and got[held[0]].score > got[held[1]].score + 1
    assert -math.inf < got[held[2]].score < -400  # a floor of 2^-1000 would be -301
    assert -20 < got[held[3]].score < 0
    coded = sum(len(t) + 1 for t in once) + 1
    assert math.isclose(got[held[0]].bits_per_byte, -got[held[0]].score / math.log10(2) / coded, rel_tol=1e-9)
