"""Vectors in columns: which take part, and how tasks read them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str = "embedding") -> Column:
    """Whether a vector is there and holds finite numbers only (never null)."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~odd, F.lit(False))


def scaled_floor(vector: str, scale: int, limit: float) -> Column:
    """floor(scale * x) of every component, as a long, clipped to -limit and limit."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), F.lit(float(scale)) * x.cast("double"))))
                       .cast("bigint"))


def matrices(lists: pa.ListArray, dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length that the lists of a batch have."""
    lengths = np.asarray(lists.value_lengths(), dtype=np.int64)
    flat = np.asarray(lists.flatten(), dtype=dtype)
    starts = np.cumsum(lengths) - lengths
    for dims in np.unique(lengths):
        at = np.flatnonzero(lengths == dims)
        yield at, flat[starts[at][:, None] + np.arange(dims)]
