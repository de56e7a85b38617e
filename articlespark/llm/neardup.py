"""Near-duplicate vectors within a label: random-hyperplane sign hashing in several
tables, exact cosine verification, connected components.

Vectors of one label and equal components are one node of the graph, with a count.
The signs of a vector's products with ``bits`` random hyperplanes are its code in a
table; vectors of one label (and length) with equal codes in some table are compared.
Two vectors at the threshold's angle agree in one sign with probability
p = 1 - angle / pi, so in one of t tables with 1 - (1 - p^bits)^t: ``plan_tables`` lets
the bits grow with the logarithm of the number of nodes, which bounds the mean bucket,
and takes the tables that reach ``MISS``.

A bucket is compared in memory, block by block of numpy products, and nothing leaves
it for a pair: only, for each node, the sum of its partners' counts and an edge to the
root of its local component.  Nodes that agree in several tables are counted in the
first of them, which their codes tell.  A bucket above ``BLOCK_ROWS`` (a group of near
copies, say) is cut into blocks by node, and each pair of blocks is a group of its own
that any task may take, so no group exceeds two blocks and no pair is left out.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label or id, link with nothing (n_links 0; a null id
has no component and is not kept); vectors of different lengths never link; rows of
one id are vectors of their own, all kept where their id is the component's; an empty
table gives no rows; other columns pass through under their own names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, ready, row_ids, written
from .components import components
from .vectors import matrices, usable

THRESHOLD = 0.93
#: Mean rows of a bucket, and the share of pairs at the threshold that may meet in no table.
BUCKET_ROWS, MISS = 64, 0.001
#: Rows of a block, and of the slice of it that one product takes.
BLOCK_ROWS, SLICE = 8192, 512
#: Large buckets that may be broadcast.
BROADCAST_ROWS = 50_000
SEED = 20240229


def plan_tables(rows: float, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(tables, bits) for labels of that many nodes."""
    bits = min(62, max(4, math.ceil(math.log2(max(1, rows) / BUCKET_ROWS))))
    same = 1 - math.acos(threshold) / math.pi
    return math.ceil(math.log(miss) / math.log1p(-same ** bits)), bits


def hyperplanes(dims: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, dims]).standard_normal((dims, tables * bits))


def sign_codes(vectors: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """A long for each row and table."""
    signs = (vectors @ hyperplanes(vectors.shape[1], tables, bits)) > 0
    return signs.reshape(len(vectors), tables, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows, scaled exactly by powers of two so that no square over- or underflows,
    and their lengths."""
    exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0))[1]
    scaled = np.ldexp(vectors, -exponent[:, None])
    return scaled, np.sqrt((scaled * scaled).sum(axis=1))


NODE_SCHEMA = "node bigint, label string, dims int, copies bigint, vector binary, signs binary, codes array<bigint>"


def _code_type(bits: int) -> np.dtype:
    return np.dtype("<u1" if bits <= 8 else "<u2" if bits <= 16 else "<u4" if bits <= 32 else "<u8")


def _encode(tables: int, bits: int, store: str):
    """``signs`` are the codes again, packed, as what travels with a node to its buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label, vector, copies = batch.columns
            for at, m in matrices(vector, np.float64):
                scaled, length = directions(m)
                rows = np.flatnonzero(length > 0)
                at, scaled = pa.array(at[rows]), scaled[rows]
                codes = sign_codes(scaled, tables, bits)
                yield pa.RecordBatch.from_arrays([
                    node.take(at), label.take(at), pa.array(np.full(len(at), m.shape[1], np.int32)), copies.take(at),
                    pa.array([v.tobytes() for v in scaled.astype(store)], pa.binary()),
                    pa.array([c.tobytes() for c in codes.astype(_code_type(bits))], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * tables, codes.ravel())],
                    names=["node", "label", "dims", "copies", "vector", "signs", "codes"])
    return run


class Forest:
    """Components of the rows of one group: each row's label is the smallest of its component."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            low = np.minimum(self.root[a], self.root[b])
            np.minimum.at(self.root, self.root[a], low)
            np.minimum.at(self.root, self.root[b], low)
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up
            apart = self.root[a] != self.root[b]
            a, b = a[apart], b[apart]


def links_in(vectors: np.ndarray, codes: np.ndarray, copies: np.ndarray, table: int, side: np.ndarray,
             threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(partners, root) of each row of one bucket: the partners' copies, counted in the first table
    where two rows agree, and the local component.  Two blocks (``side`` 0 and 1) are
    compared with each other only, one block (all 0) with itself."""
    n = len(vectors)
    partners, forest = np.zeros(n, np.int64), Forest(n)
    length = np.sqrt((vectors * vectors).sum(axis=1))
    crossed = side.any()
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if crossed else (np.arange(n),) * 2
    for k in range(0, len(left), SLICE):
        a = left[k:k + SLICE]
        others = right if crossed else right[k:]
        cosine = (vectors[a] @ vectors[others].T) / np.outer(length[a], length[others])
        i, j = np.nonzero(cosine >= threshold)
        if not crossed:
            i, j = i[later := j > i], j[later]
        x, y = a[i], others[j]
        forest.join(x, y)
        new = ~(codes[x, :table] == codes[y, :table]).any(axis=1)
        np.add.at(partners, x[new], copies[y[new]])
        np.add.at(partners, y[new], copies[x[new]])
    return partners, forest.root


GROUP = ["label", "dims", "tab", "code", "lo", "hi"]
FOUND_SCHEMA = "node bigint, partners bigint, root bigint"


def _found(rows: pa.Table, threshold: float, store: str, code_type: np.dtype) -> pa.RecordBatch:
    n = len(rows)
    node, copies, side = (np.asarray(rows[c]) for c in ("node", "copies", "side"))
    vectors = np.frombuffer(b"".join(rows["vector"].to_pylist()), store).reshape(n, -1).astype(np.float64)
    codes = np.frombuffer(b"".join(rows["signs"].to_pylist()), code_type).reshape(n, -1)
    partners, root = links_in(vectors, codes, copies, rows["tab"][0].as_py(), side, threshold)
    out = np.flatnonzero((partners > 0) | (root != np.arange(n)))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (node[out], partners[out], node[root[out]])],
                                      names=["node", "partners", "root"])


def _compare(threshold: float, store: str, code_type: np.dtype):
    """Groups arrive whole and one after another; one is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush():
            if sum(len(x) for x in held) > 1:
                yield _found(pa.Table.from_batches(held), threshold, store, code_type)

        for batch in batches:
            keys = [batch.column(c) for c in GROUP]
            turn = np.zeros(max(0, len(batch) - 1), dtype=bool)
            for column in keys:
                turn |= np.asarray(pc.not_equal(column[1:], column[:-1]))
            ends = [*(np.flatnonzero(turn) + 1).tolist(), len(batch)]
            for start, end in zip([0, *ends], ends):
                own = tuple(c[start].as_py() for c in keys)
                if own != key:
                    yield from flush()
                    key, held = own, []
                held.append(batch.slice(start, end - start))
        yield from flush()
    return run


def _buckets(nodes: DataFrame, block_rows: int) -> DataFrame:
    """A row for each node and table (for each pair of blocks, in large buckets)."""
    bucket = ["label", "dims", "tab", "code"]
    large = nodes.select("label", "dims", F.posexplode("codes").alias("tab", "code")).groupBy(*bucket).count() \
        .where(F.col("count") > block_rows)
    large = written(large.withColumn("blocks", F.ceil(F.col("count") / block_rows).cast("int")).drop("count"), "vector-buckets")
    found = large.count()
    dealt = nodes.select("*", F.posexplode("codes").alias("tab", "code"))
    if found:
        dealt = dealt.join(F.broadcast(large) if found <= BROADCAST_ROWS else large, bucket, "left")
    else:
        dealt = dealt.withColumn("blocks", F.lit(None).cast("int"))
    dealt = dealt.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(
        *bucket, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "copies", "vector", "signs")


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vectors`` (vec_id, embedding, label, ...) with n_links, component_id and kept."""
    spark: SparkSession = vectors.sparkSession
    ready(spark)
    rid, group = fresh(vectors, "row"), fresh(vectors, "group")
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable() & F.exists("embedding", lambda x: x != 0)
    numbered = row_ids(vectors, rid)
    # Equal vectors are known by 128 bits of hash; their first row stands for them.
    keys = [F.xxhash64("label", "embedding").alias("k1"), F.xxhash64(F.lit(SEED), "embedding", "label").alias("k2")]
    members = numbered.where(able).select(rid, "label", F.struct(F.col("vec_id"), F.col(rid).alias("at")).alias("own"), *keys)
    copies = members.groupBy("k1", "k2").agg(F.min("own").alias("first"), F.min("label").alias("label"), F.count(F.lit(1)).alias("copies"))
    copies = written(copies.select("k1", "k2", F.col("first.at").alias("node"), F.col("first.vec_id").alias("first_id"), "label", "copies"),
                     "vector-copies")
    # Nodes in the label that a node is in, on average over the nodes.
    mean = copies.groupBy("label").count().agg(F.sum(F.col("count") * F.col("count").cast("double")) / F.sum("count")).first()[0]
    tables, bits = plan_tables(mean or 0, threshold, miss)
    store = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    firsts = numbered.join(copies.select(F.col("node").alias(rid), "copies"), rid) \
        .select(F.col(rid).alias("node"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>"), "copies")
    nodes = written(firsts.mapInArrow(_encode(tables, bits, store), NODE_SCHEMA), "vector-codes")
    # A group is a bucket, or two blocks of a large one, which any task may take.
    met = _buckets(nodes, block_rows).repartition(*GROUP).sortWithinPartitions(*GROUP) \
        .mapInArrow(_compare(threshold, store, _code_type(bits)), FOUND_SCHEMA)
    met = written(met, "vector-links")
    partners = met.groupBy("node").agg(F.sum("partners").alias("partners"))
    # Nodes as (id, row): the smallest of a component is its smallest id.
    named = copies.select("node", F.struct("first_id", "node").alias("name"))
    edges = met.where("node <> root").select("node", "root").distinct() \
        .join(named, "node").select(F.col("name").alias("u"), F.col("root").alias("node")) \
        .join(named, "node").select("u", F.col("name").alias("v"))
    roots = components(edges).select(F.col("node.node").alias("node"), F.col("root.first_id").alias("root_id"))
    classes = copies.join(partners, "node", "left").join(roots, "node", "left").select(
        "k1", "k2", (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("links"),
        F.coalesce("root_id", "first_id").alias("component"))
    told = members.join(classes, ["k1", "k2"]).select(F.col(rid), F.struct("links", "component").alias(group))
    out = numbered.join(told, rid, "left")
    component = F.coalesce(F.col(group)["component"], F.col("vec_id"))
    return out.select(
        *vectors.columns, F.coalesce(F.col(group)["links"], F.lit(0)).cast("bigint").alias(fresh(vectors, "n_links")),
        component.alias(fresh(vectors, "component_id")),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias(fresh(vectors, "kept")))
