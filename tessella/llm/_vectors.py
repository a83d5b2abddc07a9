"""Vectors of Arrow batches as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(column: str = "embedding") -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(column).isNotNull() & ~F.exists(F.col(column).cast("array<double>"), odd)


def vectors(df: DataFrame, *columns: Column) -> DataFrame:
    """The given columns and `v`, the vector as doubles, of the rows whose vector is finite."""
    return df.where(finite()).select(*columns, F.col("embedding").cast("array<double>").alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """A batch of vectors as rows. Vectors of different lengths have no common space: ValueError."""
    if not len(column):
        return np.zeros((0, 0))
    n = np.diff(np.asarray(column.offsets))
    if n.min() != n.max():
        raise ValueError(f"vectors of {n.min()} and of {n.max()} components in one table")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), int(n[0]))


def floors(v: np.ndarray, factor: int, most: int) -> np.ndarray:
    """floor(factor * v) as 64-bit integers; OverflowError where one is above `most`, since exact sums of them would not fit."""
    out = np.floor(v * factor)
    if out.size and np.abs(out).max() > most:
        raise OverflowError(f"a component times {factor} is above {most}")
    return out.astype(np.int64)
