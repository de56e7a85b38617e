"""Centroid clustering over zone maps along a space-filling curve.

Vectors (integers, floor(64 * x)) are put in the order of a Hilbert curve through all
their dimensions, the widest first, and cut into blocks of ``BLOCK_ROWS`` neighbours
that carry a box, the least and largest number of each dimension.  In a round, a
block's box decides which centroids any of its vectors may be nearest to: with c' the
one nearest to the box's middle, the difference of squared distances |v - c|^2 - |v - c'|^2
is linear in v, so its least value over the box is exact, and c is out where that is
above 0.  The candidates left are compared with the block's vectors in one exact integer
product; a block with one candidate adds its vectors' sum without comparing.

Centroids and their sums (k times 64 numbers) are all that passes through the driver.
Sums are whole numbers, so results do not depend on the order of rows or tasks.

Defined results: vectors that are null, of another length than ``dims`` or hold null or
non-finite components are left out; numbers are clipped to +-2^26; rows with a null id
are clustered, but start no centroid; of rows with one id any may start one, the
smaller vectors first; with fewer ids than centroids there are as many centroids; equal
vectors are nearest to the same, smallest centroid; sums beyond 64 bits are null; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, written
from .vectors import matrices, scaled_floor, usable

DIMS, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
BLOCK_ROWS = 256
#: Bits of a dimension that the curve sees; numbers beyond +-LIMIT are clipped.
CURVE_BITS = 4
LIMIT = 2.0 ** 26


def hilbert_keys(cells: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """The place of each row's cell (dims numbers of ``bits`` bits) on the Hilbert curve, as
    big-endian bytes.

    From the highest bit of the cells down, the sub-cube that a point is in says how the
    curve is mirrored and turned inside it; undoing that for the lower bits leaves
    numbers whose bits, taken across the dimensions, are the place in Gray code."""
    x = cells.astype(np.uint32).T.copy()
    dims, one = len(x), np.uint32(1)
    for bit in range(bits - 1, 0, -1):
        low = np.uint32((1 << bit) - 1)
        for d in range(dims):
            upper = (x[d] >> np.uint32(bit) & one).astype(bool)
            swap = np.where(upper, 0, (x[0] ^ x[d]) & low).astype(np.uint32)
            x[0] ^= np.where(upper, low, swap).astype(np.uint32)
            x[d] ^= swap
    across = np.stack([x >> np.uint32(b) & one for b in range(bits - 1, -1, -1)]).reshape(bits * dims, -1)
    return np.packbits(np.bitwise_xor.accumulate(across, axis=0).astype(np.uint8).T, axis=1)


def _place(low: np.ndarray, width: np.ndarray, order: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in matrices(batch.column(1), np.int64):
                cells = np.minimum((x - low) * (1 << CURVE_BITS) // width, (1 << CURVE_BITS) - 1)
                keys = pa.array([k.tobytes() for k in hilbert_keys(cells[:, order])], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=["vec_id", "numbers", "place"])
    return run


BLOCK_SCHEMA = "ids array<bigint>, low array<bigint>, high array<bigint>, numbers binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours in place order become blocks of one row, with their boxes."""
    held: list[tuple[pa.Array, np.ndarray]] = []

    def blocks(last: bool):
        ids, x = pa.concat_arrays([i for i, _ in held]), np.concatenate([x for _, x in held])
        held.clear()
        end = len(x) if last else len(x) // BLOCK_ROWS * BLOCK_ROWS
        for k in range(0, end, BLOCK_ROWS):
            part = x[k:min(end, k + BLOCK_ROWS)]
            yield pa.RecordBatch.from_pylist([dict(
                ids=ids[k:k + len(part)].to_pylist(), low=part.min(axis=0).tolist(), high=part.max(axis=0).tolist(),
                numbers=part.astype("<i4").tobytes())], schema=_BLOCK)
        if end < len(x):
            held.append((ids[end:], x[end:]))

    for batch in batches:
        for _, x in matrices(batch.column(1), np.int64):
            held.append((batch.column(0), x))
            if sum(len(h) for _, h in held) >= BLOCK_ROWS:
                yield from blocks(False)
    if held:
        yield from blocks(True)


_LONGS = pa.list_(pa.int64())
_BLOCK = pa.schema([("ids", _LONGS), ("low", _LONGS), ("high", _LONGS), ("numbers", pa.binary())])


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids that a vector in the box may be nearest to (ties included)."""
    best = ((2 * centroids - (low + high)) ** 2).sum(axis=1).argmin()
    squares = (centroids * centroids).sum(axis=1)
    slope = 2 * (centroids[best] - centroids)
    least = squares - squares[best] + np.minimum(slope * low, slope * high).sum(axis=1)
    return np.flatnonzero(least <= 0)


def nearest(x: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each row, exact; ties to the smaller number."""
    c = centroids[among]
    largest = float(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    exact = 4 * x.shape[1] * largest * largest < 2.0 ** 53
    products = (x.astype(float) @ c.T.astype(float)).astype(np.int64) if exact else x @ c.T
    distance = (x * x).sum(axis=1)[:, None] - 2 * products + (c * c).sum(axis=1)
    at = distance.argmin(axis=1)
    return among[at], distance[np.arange(len(x)), at]


def _unpacked(batches: Iterator[pa.RecordBatch], centroids: np.ndarray):
    """(ids, vectors, candidates) of each block."""
    for batch in batches:
        for ids, low, high, numbers in zip(batch.column("ids"), *(batch.column(c).to_pylist() for c in ("low", "high", "numbers"))):
            x = np.frombuffer(numbers, "<i4").reshape(-1, centroids.shape[1]).astype(np.int64)
            yield ids.values, x, candidates(np.array(low), np.array(high), centroids)


def _sums(centroids: np.ndarray):
    """Each centroid's vectors added up over a task; the last number is their count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        total = np.zeros((k, dims + 1), np.int64)
        for _, x, among in _unpacked(batches, centroids):
            if len(among) == 1:
                total[among[0]] += [*x.sum(axis=0), len(x)]
                continue
            own, _ = nearest(x, centroids, among)
            for c in np.unique(own):
                mine = x[own == c]
                total[c] += [*mine.sum(axis=0), len(mine)]
        used = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, dims + 1).astype(np.int32)), pa.array(np.tile(np.arange(dims + 1, dtype=np.int32), len(used))),
             pa.array(total[used].ravel())], names=["cluster", "at", "total"])
    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, among in _unpacked(batches, centroids):
            own, distance = nearest(x, centroids, among)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), pa.array(distance)],
                                             names=["vec_id", "cluster", "distance"])
    return run


def zone_blocks(vectors: DataFrame) -> DataFrame:
    """``vectors`` (vec_id, numbers) as blocks of neighbours on the curve."""
    spread = vectors.select(F.posexplode("numbers").alias("at", "x")).groupBy("at") \
        .agg(F.min("x"), F.max("x"), F.var_pop("x").alias("var")).orderBy("at").collect()
    low = np.array([r[1] for r in spread], dtype=np.int64)
    width = np.array([r[2] - r[1] + 1 for r in spread], dtype=np.int64)
    order = np.argsort([-r["var"] for r in spread], kind="stable")
    placed = vectors.mapInArrow(_place(low, width, order), "vec_id bigint, numbers array<bigint>, place binary")
    # Equal places (copies) may be dealt to several ranges by their ids.
    deal = F.xxhash64("vec_id")
    return placed.repartitionByRange(F.col("place"), deal).sortWithinPartitions(F.col("place"), deal) \
        .select("vec_id", "numbers").mapInArrow(_pack, BLOCK_SCHEMA)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each
    vector of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    ready(spark)
    kept = vectors.where(usable() & (F.size("embedding") == dims)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), scaled_floor("embedding", scale, LIMIT).alias("numbers"))
    kept = written(kept, "zone-vectors")
    first = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("hash")
    start = kept.where("vec_id is not null").select(first, "numbers").orderBy("hash", "numbers").limit(k).collect()
    if not start:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, "
                                         "inertia bigint, centroid_sha256 string")
    blocks = written(zone_blocks(kept), "zone-blocks")
    centroids = np.array([r["numbers"] for r in start], dtype=np.int64)
    for _ in range(rounds):
        parts = blocks.mapInArrow(_sums(centroids), "cluster int, at int, total bigint")
        total = np.zeros((len(centroids), dims + 1), dtype=object)
        for c, at, value in parts.groupBy("cluster", "at").agg(F.sum("total")).collect():
            total[c, at] = value
        centroids = np.array([[s // t[-1] for s in t[:-1]] if t[-1] else old for t, old in zip(total.tolist(), centroids.tolist())],
                             dtype=np.int64)
    found = written(blocks.mapInArrow(_assign(centroids), "vec_id bigint, cluster int, distance bigint"), "zone-clusters")
    inertia = dict(found.groupBy("cluster").agg(F.try_sum("distance")).collect())
    whole = None if None in inertia.values() or (s := sum(inertia.values())) >= 2 ** 63 else s
    told = [(c, inertia[c], whole, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest())
            for c, v in enumerate(centroids.tolist()) if c in inertia]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select(  # k rows at most
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
