"""Language identification as mixture inference.

Each language is a distribution over hashed three-byte grams of lower-cased words
(with blanks at both ends), learned from labelled documents.  A document is a
mixture: expectation-maximisation estimates its languages' proportions from its
words' gram likelihoods.  Nested sets of its strongest languages are fitted again
and the set with the best penalised likelihood (the logarithm of the number of words
for each further language) is kept; the language with the largest share is
the prediction, its share the score.

Defined results: a null text, one without letters, and any text if nothing was
learned, is ``und`` with score 0; equal shares go to the smaller label; a null lang
teaches nothing; a null doc_id is neither held out nor learned from; repeated rows
are judged one by one; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready
from .words import SEP, _lut, iter_words

BUCKETS = 1 << 16
#: Labelled documents that one language's counts are learned from at most, by hash.
DOCS_PER_LANGUAGE = 50_000
UNKNOWN = "und"
MIN_SHARE = 0.005

LETTERS = _lut(lambda b: b < 0x80 and not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))


@dataclass
class Grams:
    gram: np.ndarray        # bucket of each letter byte's gram
    word_first: np.ndarray  # first gram of each word
    first: np.ndarray       # first word of each document, one more than documents
    ascii_letters: np.ndarray  # how many of a document's bytes are ASCII letters


def grams(words) -> Grams:
    d = words.data
    inside = np.flatnonzero(d != SEP)
    lead, trail = np.zeros(len(d), dtype=bool), np.zeros(len(d), dtype=bool)
    lead[words.starts] = True
    trail[words.ends - 1] = True
    before = np.where(lead[inside], SEP, d[np.maximum(inside, 1) - 1]).astype(np.uint32)
    after = np.where(trail[inside], SEP, d[np.minimum(inside + 1, len(d) - 1)]).astype(np.uint32)
    gram = ((before << np.uint32(16) | d[inside].astype(np.uint32) << np.uint32(8) | after)
            * np.uint32(0x9E3779B1)) >> np.uint32(16)
    plain = np.concatenate([[0], np.cumsum((d != SEP) & (d < 0x80))])
    return Grams(gram.astype(np.int64), np.searchsorted(inside, words.starts), words.first,
                 plain[words.offsets[1:]] - plain[words.offsets[:-1]])


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # log-probabilities, BUCKETS x languages, float32


def _count_grams(labels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {x: k for k, x in enumerate(labels)}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            lang = np.array([known.get(x, -1) for x in batch.column(0).to_pylist()], dtype=np.int64)
            for w in iter_words(batch.column(1), LETTERS, 1 << 20):
                g = grams(w)
                word_lang = np.repeat(lang[w.lo:w.hi], w.counts())
                of = np.repeat(word_lang, np.diff(np.append(g.word_first, len(g.gram))))
                for k in np.unique(of[of >= 0]).tolist():
                    total.setdefault(k, np.zeros(BUCKETS, np.int64))
                    total[k] += np.bincount(g.gram[of == k], minlength=BUCKETS)
        for k, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])],
                names=["k", "gram", "n"])
    return run


def learn(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Learn from rows of (doc_id, text, lang).  Rows are thinned by hash to about
    ``docs_per_language`` for each language; grams are counted in the tasks, and what
    reaches the driver is one number for each language and bucket."""
    ready(labelled.sparkSession)
    rows = labelled.select(F.col("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang")) \
        .where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    labels = sorted(sizes)
    if not labels:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    share = F.lit(1.0)
    for x in labels:
        if sizes[x] > docs_per_language:
            share = F.when(F.col("lang") == x, docs_per_language / sizes[x]).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(71)), F.lit(1 << 20)) < share * (1 << 20))
    counts = picked.select("lang", "text").mapInArrow(_count_grams(labels), "k int, gram int, n bigint") \
        .groupBy("k", "gram").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((BUCKETS, len(labels)), 0.05)
    table[counts["gram"].to_numpy(), counts["k"].to_numpy()] += counts["n"].to_numpy()
    return Model(labels, np.log(table / table.sum(axis=0)).astype(np.float32))


def _fit(weight: np.ndarray, doc: np.ndarray, first: np.ndarray, n: np.ndarray, share: np.ndarray,
         rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM over words; returns shares and each document's log-likelihood."""
    for _ in range(rounds):
        part = weight * share[doc]
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, first, axis=0) / n[:, None]
    return share, np.add.reduceat(np.log((weight * share[doc]).sum(axis=1)), first)


def _words_of(first: np.ndarray, count: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Indices of the words of some documents."""
    n = count[some]
    return np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def infer(g: Grams, model: Model, rounds: int = 8) -> np.ndarray:
    """Shares of the languages in each document (rows of zeros without words)."""
    n_docs, k = len(g.first) - 1, len(model.labels)
    out = np.zeros((n_docs, k), dtype=np.float32)
    count = np.diff(g.first)
    has = np.flatnonzero(count)
    if not len(has) or not k:
        return out
    n, first = count[has].astype(np.float32), g.first[:-1][has]
    doc = np.repeat(np.arange(len(has)), count[has])
    weight = np.add.reduceat(model.table[g.gram], g.word_first, axis=0)
    weight = np.exp(np.maximum(weight - weight.max(axis=1, keepdims=True), -60))
    share, _ = _fit(weight, doc, first, n, np.full((len(has), k), 1 / k, np.float32), rounds)
    order = np.argsort(-share, axis=1, kind="stable")
    strongest = np.zeros(share.shape, dtype=bool)
    np.put_along_axis(strongest, order[:, :1], True, axis=1)
    best = strongest.astype(np.float32)
    best_value = np.add.reduceat(np.log(np.maximum(weight[np.arange(len(doc)), order[doc, 0]], 1e-30)), first)
    for size in range(2, k + 1):
        # A language without a noticeable share in the full mixture can't pay for itself.
        some = np.flatnonzero(np.take_along_axis(share, order[:, size - 1:size], axis=1)[:, 0] > MIN_SHARE)
        if not len(some):
            break
        words = _words_of(first, count[has], some)
        m = count[has][some]
        part_first = np.cumsum(m) - m
        allowed = np.zeros((len(some), k), dtype=bool)
        np.put_along_axis(allowed, order[some, :size], True, axis=1)
        start = np.where(allowed, np.maximum(share[some], MIN_SHARE), 0)
        fitted, value = _fit(weight[words], np.repeat(np.arange(len(some)), m), part_first, n[some],
                             (start / start.sum(axis=1, keepdims=True)).astype(np.float32), rounds)
        value = value - (size - 1) * np.log(np.maximum(n[some], 2))
        better = value > best_value[some]
        best[some[better]], best_value[some[better]] = fitted[better], value[better]
    out[has] = best
    return out


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        chunk = max(1 << 14, (1 << 22) // max(4, len(m.labels)))
        for batch in batches:
            texts = batch.column(1)
            shares, letters = [], []
            for w in iter_words(texts, LETTERS, chunk):
                g = grams(w)
                shares.append(infer(g, m))
                ok = g.ascii_letters > 0
                for k in np.flatnonzero(~ok & (w.counts() > 0)).tolist():
                    ok[k] = any(map(str.isalpha, texts[w.lo + k].as_py()))
                letters.append(ok)
            share = np.concatenate(shares) if shares else np.zeros((0, len(m.labels)), np.float32)
            ok = np.concatenate(letters) if letters else np.zeros(0, bool)
            ok &= len(m.labels) > 0
            top = share.argmax(axis=1) if len(m.labels) else np.zeros(len(ok), np.int64)
            pred = [m.labels[t] if o else UNKNOWN for t, o in zip(top.tolist(), ok.tolist())]
            score = np.where(ok, share.max(axis=1, initial=0), 0).clip(0, 1).astype(np.float64)
            mixture = [[{"lang": m.labels[j], "share": float(s[j])} for j in np.flatnonzero(s).tolist()] if o else []
                       for s, o in zip(share, ok.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score),
                 pa.array(mixture, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                names=["row", "lang_pred", "score", "mixture"])
    return run


def identify(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """A struct ``row`` of the ``carry`` columns, lang_pred, score and the mixture.
    The model's size is buckets times languages; it is broadcast."""
    spark = docs.sparkSession
    ready(spark)
    frame = docs.select(F.struct(*carry).alias("row"), "text")
    kind = frame.schema["row"].dataType.simpleString()
    return frame.mapInArrow(_predict(spark.sparkContext.broadcast(model)),
                            f"row {kind}, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2 (null: no)."""
    from .common import crc_mod
    return F.coalesce(crc_mod(doc_id, 4) == 2, F.lit(False))


def learn_from_documents(docs: DataFrame, **options) -> Model:
    """Learn from the documents that are not held out."""
    from .common import crc_mod
    return learn(docs.where(crc_mod(F.col("doc_id"), 4) != 2), **options)
