"""Whitening by the leading eigenvectors of the covariance, found by Chebyshev-filtered
subspace iteration.

Vectors become integers x = floor(1024 * c) + 100000; sums are exact, and every product
takes (n*x - S) / n, so nothing is lost to the large common offset.  The covariance V is
never formed: a pass over the vectors gives V Q = X^T (X Q) / n for a block Q of a few
columns, each task returning its own sum and Spark adding them up.

A round applies a Chebyshev polynomial of V to the block by the three-term recurrence
(one pass a degree).  It is small on the unwanted eigenvalues, from 0 to the block's
smallest Ritz value, and grows fast above them.  Then QR, and Rayleigh-Ritz in the new block, which
also gives the residuals |V u - e u|.  Vectors whose residual is at rounding level are
locked: they leave the filter and are projected out of it.  The result is certified when
all wanted ones are; without that after ``MAX_ROUNDS`` it fails rather than return an estimate.

Defined results: rows whose vector is null or holds null or non-finite components are
dropped; entries are clipped so that |x| stays below 2^52; vectors of each length are
fitted and whitened among themselves; rows with a null or repeated id are rows like
others; components without variance (eigenvalue under 1e-12 of the largest) are not
given, so equal vectors, and a single one, give no rows; an empty table gives no rows;
deviation is null where it exceeds 64 bits; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, written
from .vectors import matrices, scaled_floor, usable

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: Columns beyond the wanted ones: the more, the further the unwanted eigenvalues lie below.
GUARD = 32
#: Growth of one filter (as a power of e) and degrees of it at most.
GROWTH, MAX_DEGREE = 30.0, 32
#: Residuals, as shares of the largest eigenvalue: rounding level, and what counts if rounds no longer lower it.
ROUNDING, NEARLY, MAX_ROUNDS = 2e-14, 1e-11, 200
SEED = 7
LIMIT = 2.0 ** 52 - 2 * SHIFT


@dataclass
class Fit:
    """The vectors' number and sums (exact), and the largest |x|."""
    n: int
    sums: list[int]
    largest: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, rounded once where n*x fits 64 bits."""
        if self.n * self.largest < 2 ** 62:
            return (self.n * x - np.array(self.sums, dtype=np.int64)) / self.n
        return (x.astype(np.longdouble) - np.array([s / self.n for s in self.sums], dtype=np.longdouble)).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n*x - S)^2 of each row, exact."""
        rough = (self.centred(x) ** 2).sum(axis=1) * float(self.n) ** 2
        if self.n * self.largest < 2 ** 62 and rough.max(initial=0) < 2.0 ** 62:
            return ((self.n * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = (sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist())
        return [v if v < 2 ** 63 else None for v in exact]


def _xs(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for _, x in matrices(batch.column(column), np.int64):
            yield batch, x


def _first_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n, largest |x| and sums of a task, each x as two halves so that no sum overflows."""
    total = None
    for _, x in _xs(batches):
        part = np.stack([(x >> 26).sum(axis=0), (x & (1 << 26) - 1).sum(axis=0), np.full(x.shape[1], len(x)), np.abs(x).max(axis=0)])
        total = part if total is None else np.vstack([total[:3] + part[:3], np.maximum(total[3], part[3])])
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1], dtype=np.int32)), *map(pa.array, total)],
                                         names=["at", "high", "low", "n", "largest"])


def _fit(xs: DataFrame) -> Fit:
    parts = xs.mapInArrow(_first_sums, "at int, high bigint, low bigint, n bigint, largest bigint")
    sums = parts.groupBy("at").agg(F.sum("high"), F.sum("low"), F.sum("n"), F.max("largest")).orderBy("at").collect()
    return Fit(sums[0][3], [(r[1] << 26) + r[2] for r in sums], max(r[4] for r in sums))


def _added(xs: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of an array that ``of`` makes of a matrix of vectors: each task
    adds up its own, Spark adds up the tasks'; as large as the array, whatever the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _xs(batches):
            total = of(x) if total is None else total + of(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["at", "value"])

    rows = xs.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(rows))
    for at, value in rows:
        out[at] = value
    return out


def chebyshev(product: Callable, q: np.ndarray, vq: np.ndarray, degree: int, cut: float, top: float,
              locked: np.ndarray) -> np.ndarray:
    """The polynomial of that degree, small on 0..cut and 1 at ``top``, of V applied to
    ``q`` (``vq`` is V q), kept orthogonal to the locked vectors."""
    half = cut / 2
    sigma = half / (top - half)
    tau = 2 / sigma
    before, now = q, (vq - half * q) * (sigma / half)
    for _ in range(degree - 1):
        now -= locked @ (locked.T @ now)
        after = 1 / (tau - sigma)
        before, now = now, (product(now) - half * now) * (2 * after / half) - sigma * after * before
        sigma = after
    return now - locked @ (locked.T @ now)


def leading_eigenvectors(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int = COMPONENTS,
                         guard: int = GUARD) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the operator, certified."""
    wanted, m = min(dims, wanted), min(dims, wanted + guard)
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, m)))[0]
    best = math.inf
    for _ in range(MAX_ROUNDS):
        vq = product(q)
        h = q.T @ vq
        values, z = np.linalg.eigh((h + h.T) / 2)
        values, z = values[::-1], z[:, ::-1]
        q, vq = q @ z, vq @ z
        top = values[0]
        if top <= 0:
            return np.zeros(wanted), q[:, :wanted]
        residual = np.linalg.norm(vq - q * values, axis=0)[:wanted] / top
        worst = residual.max()
        if worst <= ROUNDING or worst <= NEARLY and worst > best / 2 or m == dims and best < math.inf:
            return values[:wanted], q[:, :wanted]
        best = min(best, worst)
        if m == dims:  # the block holds every eigenvector; once more, from nearly diagonal
            q = np.linalg.qr(q)[0]
            continue
        done = int(np.argmax(residual > ROUNDING))
        locked, rest = q[:, :done], slice(done, m)
        cut = max(values[-1], 1e-6 * values[done])
        growth = math.acosh(2 * values[done] / cut - 1) if values[done] > cut else 0
        degree = min(MAX_DEGREE, max(2, int(GROWTH / growth) if growth else MAX_DEGREE))
        y = chebyshev(product, q[:, rest], vq[:, rest], degree, cut, max(values[done], cut * (1 + 1e-6)), locked)
        y /= np.maximum(np.linalg.norm(y, axis=0), np.finfo(float).tiny)
        y -= locked @ (locked.T @ y)
        q = np.linalg.qr(np.hstack([locked, y]))[0]
    raise RuntimeError(f"eigenvectors not certified after {MAX_ROUNDS} rounds: residual {best:.1e} of the largest eigenvalue")


OUT_SCHEMA = "vec_id bigint, deviation bigint, whitened array<double>"


def _whiten(fit: Fit, project: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _xs(batches, 1):
            out = fit.centred(x) @ project
            lists = pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * project.shape[1], out.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fit.deviations(x), pa.int64()), lists],
                                             names=["vec_id", "deviation", "whitened"])
    return run


def _whiten_length(rows: DataFrame, dims: int, components: int) -> DataFrame | None:
    rows = rows.where(F.col("dims") == dims)
    xs = rows.select("x")
    fit = _fit(xs)
    trace = _added(xs, lambda x: np.array([(fit.centred(x) ** 2).sum()]))[0] / fit.n

    def product(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = fit.centred(x)
            return c.T @ (c @ q)
        return _added(xs, part).reshape(q.shape) / fit.n

    values, vectors = leading_eigenvectors(product, dims, components) if trace > 0 else (np.zeros(1), np.zeros((dims, 1)))
    given = values > 1e-12 * values[0]
    if not given.any():
        return None
    project = vectors[:, given] / np.sqrt(values[given])
    whitened = rows.select("vec_id", "x").mapInArrow(_whiten(fit, project), OUT_SCHEMA)

    def moments(x: np.ndarray) -> np.ndarray:
        w = fit.centred(x) @ project
        return np.vstack([w.sum(axis=0), w.T @ w])

    first, second = np.split(_added(xs, moments).reshape(-1, given.sum()) / fit.n, [1])
    error = float(np.abs(second - first.T @ first - np.eye(given.sum())).max())
    explained = F.array(*(F.lit(float(v / trace)) for v in values[given]))
    return whitened.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row
    of ``vectors`` (vec_id, embedding) and each of the leading components."""
    spark = vectors.sparkSession
    ready(spark)
    x = F.transform(scaled_floor("embedding", scale, LIMIT), lambda v: v + shift)
    rows = vectors.where(usable() & (F.size("embedding") > 0)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"), F.size("embedding").alias("dims"))
    rows = written(rows, "whitening-numbers")
    lengths = sorted(r[0] for r in rows.select("dims").distinct().collect())
    parts = [p for p in (_whiten_length(rows, d, components) for d in lengths) if p is not None]
    empty = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], empty)
