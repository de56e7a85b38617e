"""Exact top-k inner products by the threshold algorithm.

Vectors become blocks (columns of numbers).  Candidate blocks are dealt into groups of
about ``GROUP_ROWS`` rows, and the blocks of queries go to every group.  A group keeps
one list for each dimension, sorted by component; a query walks its lists from the end
its sign prefers, scores each newly met vector in full, and stops when the sum of its
components at the present depth is below its k-th score, as no vector it has not met
can reach that score then.  Equal scores may still win by a smaller id, so a bound that
equals the k-th score does not stop it.  Each group returns k rows for a query and the
best k of all groups remain.

Defined results: vectors that are null or hold null or non-finite components, and rows
with a null id, take no part; vectors of different lengths are not compared; a query
never meets its own row, but does meet other rows of its id; with fewer than k
candidates all are returned; components beyond 64 bits are clipped, and sums beyond 64
bits wrap; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, written

GROUP_ROWS = 8192
QUERY_ROWS = 256
FIRST_DEPTH = 8

BLOCK_SCHEMA = "query boolean, name string, dims int, n int, uids binary, ids binary, numbers binary"
HIT_SCHEMA = "quid bigint, query_id bigint, vec_id bigint, cuid bigint, score bigint"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, row, made = TaskContext.get().partitionId(), 0, 0
    held: dict[tuple[bool, int], list[tuple]] = {}

    def block(key):
        nonlocal made
        uids, ids, numbers = zip(*held.pop(key))
        made += 1
        data = [np.asarray(uids, "<i8").tobytes(), np.asarray(ids, "<i8").tobytes(), np.asarray(numbers, "<i8").tobytes()]
        return pa.RecordBatch.from_pylist([dict(
            query=key[0], name=f"{part}-{made}", dims=key[1], n=len(ids),
            **dict(zip(("uids", "ids", "numbers"), data)))], schema=_BLOCK)

    for batch in batches:
        for vec_id, is_query, numbers in zip(*(c.to_pylist() for c in batch.columns)):
            uid, row = part << 40 | row, row + 1
            for query in ([False, True] if is_query else [False]):
                key = (query, len(numbers))
                held.setdefault(key, []).append((uid, vec_id, numbers))
                if len(held[key]) >= (QUERY_ROWS if query else GROUP_ROWS):
                    yield block(key)
    for key in list(held):
        yield block(key)


_BLOCK = pa.schema([("query", pa.bool_()), ("name", pa.string()), ("dims", pa.int32()), ("n", pa.int32()),
                    ("uids", pa.binary()), ("ids", pa.binary()), ("numbers", pa.binary())])


class SortedLists:
    """The lists of a set of candidates."""

    def __init__(self, uids: np.ndarray, ids: np.ndarray, numbers: np.ndarray):
        self.uids, self.ids, self.numbers = uids, ids, numbers
        self.order = np.argsort(numbers, axis=0, kind="stable")
        self.sorted = np.take_along_axis(numbers, self.order, axis=0)
        self.largest = float(np.abs(numbers.astype(np.float64)).max(initial=0))
        self.floats = numbers.astype(np.float64)
        self.spot = {int(u): k for k, u in enumerate(uids)}

    def top(self, quid: int, q: np.ndarray, k: int, held: tuple) -> tuple:
        """Better of ``held`` and this set: k (scores, ids, uids) in order."""
        n, dims = self.numbers.shape
        scores, ids, uids = held
        exact = self.largest * float(np.abs(q.astype(np.float64)).max(initial=0)) * max(1, dims) < 2.0 ** 53
        table, weight = (self.floats, q.astype(np.float64)) if exact else (self.numbers, q)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        met = np.zeros(n, dtype=bool)
        if quid in self.spot:
            met[self.spot[quid]] = True
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            end = min(n, depth + step)
            if end == n:
                new = np.flatnonzero(~met)
            else:
                now = np.zeros(n, dtype=bool)
                now[self.order[n - end:n - depth][:, up].ravel()] = True
                now[self.order[depth:end][:, down].ravel()] = True
                new = np.flatnonzero(now & ~met)
            met[new] = True
            if len(new):
                value = (table[new] @ weight).astype(np.int64)
                if len(scores) == k:
                    keep = value >= scores[-1]
                    new, value = new[keep], value[keep]
                scores = np.concatenate([scores, value])
                ids, uids = np.concatenate([ids, self.ids[new]]), np.concatenate([uids, self.uids[new]])
                best = np.lexsort((uids, ids, -scores))[:k]
                scores, ids, uids = scores[best], ids[best], uids[best]
            if end < n and len(scores) == k:
                bound = float((weight[up] * self.sorted[n - end, up]).sum() + (weight[down] * self.sorted[end - 1, down]).sum())
                if (bound if exact else bound + abs(bound) * 1e-6 + 1) < scores[-1]:
                    break
            depth, step = end, step * 2
        return scores, ids, uids


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting, lists = None, {}, {}

        def add(dims: int) -> None:
            held = waiting.pop(dims)
            lists.setdefault(dims, []).append(SortedLists(*map(np.concatenate, zip(*held))))

        for batch in batches:
            for r in batch.to_pylist():
                if r["grp"] != group:
                    group, waiting, lists = r["grp"], {}, {}
                dims, n = r["dims"], r["n"]
                uids, ids = np.frombuffer(r["uids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                numbers = np.frombuffer(r["numbers"], "<i8").reshape(n, dims)
                if not r["query"]:
                    waiting.setdefault(dims, []).append((uids, ids, numbers))
                    if sum(len(x[0]) for x in waiting[dims]) >= GROUP_ROWS:
                        add(dims)
                    continue
                for d in list(waiting):
                    add(d)
                out: list[tuple] = []
                for quid, qid, q in zip(uids.tolist(), ids.tolist(), numbers):
                    held = tuple(np.empty(0, np.int64) for _ in range(3))
                    for part in lists.get(dims, ()):
                        held = part.top(quid, q, k, held)
                    out += [(quid, qid, v, c, s) for s, v, c in zip(*(x.tolist() for x in held))]
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                 names=["quid", "query_id", "vec_id", "cuid", "score"])
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) for each query row of ``vectors`` (vec_id,
    embedding), by integer inner product of floor(scale * component)."""
    spark = vectors.sparkSession
    ready(spark)
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where("vec_id is not null and embedding is not null").where(~odd)
    limit = 2.0 ** 63 / scale / 2
    number = F.transform(F.transform("embedding", lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), x.cast("double")))),
                         lambda x: F.floor(F.lit(scale) * x).cast("bigint"))
    blocks = written(rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), is_query.alias("query"), number.alias("numbers"))
                     .mapInArrow(_blocks, BLOCK_SCHEMA), "topk-blocks")
    total = blocks.where("not query").agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // GROUP_ROWS))
    dealt = blocks.withColumn("grp", F.explode(F.when(F.col("query"), F.sequence(F.lit(0), F.lit(groups - 1)))
                                               .otherwise(F.array(F.pmod(F.xxhash64("name"), F.lit(groups)).cast("int")))))
    hits = dealt.repartition(groups, "grp").sortWithinPartitions("grp", "query", "name").mapInArrow(_search(k), HIT_SCHEMA)
    rank = F.row_number().over(Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "cuid"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
