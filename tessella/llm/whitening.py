"""Embedding whitening by merged singular value decompositions.

Every partition of the distinct vectors keeps a count, integer sums and the full-rank singular values and right vectors of its centred rows.
Two such states merge without loss: their scaled vectors, one under the other, and one row more that corrects for the
distance between their means, are decomposed again. States merge along a tree; their size hangs on the dimension only.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mapped, stored
from ._vectors import floors, matrix, vectors

#: Integers are floor(FACTOR * c) + SHIFT.
FACTOR, SHIFT = 64, 1_000_000
#: Components that are returned at most.
COMPONENTS = 16
#: Rows that are decomposed at once.
STEP = 2048
#: Largest integer of a component, and of a product that must fit 64 bits.
MOST, MOST_PRODUCT = 1 << 40, 1 << 62
_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

#: Rows, their sums less the shift, singular values, right singular vectors.
State = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = (floors(matrix(batch.column("v")), FACTOR, MOST) + SHIFT).astype("<i8")
            yield pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])


def _unpacked(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    if len({len(r) for r in rows}) > 1:
        raise ValueError("vectors of different lengths in one table")
    return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), -1)


def decomposed(x: np.ndarray) -> State:
    """State of some rows of integers. They are centred exactly but for one division before they are decomposed."""
    y = x - SHIFT
    sums = y.sum(axis=0)
    _, s, vt = np.linalg.svd(y - sums / len(y), full_matrices=False)
    return len(y), sums, s, vt


def merged(a: State, b: State) -> State:
    n = a[0] + b[0]
    if a[1].shape != b[1].shape:
        raise ValueError("vectors of different lengths in one table")
    apart = np.sqrt(a[0] * b[0] / n) * (a[1] / a[0] - b[1] / b[0])
    _, s, vt = np.linalg.svd(np.vstack([a[2][:, None] * a[3], b[2][:, None] * b[3], apart]), full_matrices=False)
    rank = min(len(s), len(apart))
    return n, a[1] + b[1], s[:rank], vt[:rank]


def _moments(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = w.mean(axis=0)
    return len(w), mean, (w - mean).T @ (w - mean)


def _merged_moments(a, b):
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _tree(fit: DataFrame, of_rows: Callable, merge: Callable):
    """of_rows of runs of rows, merged within each partition, then between partitions along a tree."""

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                found = of_rows(_unpacked(batch.column("x").slice(at, STEP)))
                state = found if state is None else merge(state, found)
        if state is not None:
            yield pa.record_batch([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

    return mapped(fit, states, "state binary").rdd.map(lambda r: [pickle.loads(bytes(r.state))]).treeAggregate([], lambda a, b: [reduce(merge, a + b)], lambda a, b: [reduce(merge, a + b)] if a + b else [])


class Whitening:
    """n, exact sums and unit eigenvectors of the distinct integer vectors, from a merged state."""

    def __init__(self, state: State, components: int = COMPONENTS):
        self.n, less, s, vt = state
        self.sums = less + SHIFT * self.n
        real = s > s[:1] * max(vt.shape) * np.finfo(float).eps  # the others are zero but for rounding
        e = s * s / self.n
        self.trace = e.sum()
        self.e, self.v = e[real][:components], vt[real][:components]
        self.v = self.v * np.sign(self.v[np.arange(len(self.v)), np.abs(self.v).argmax(axis=1)])[:, None]

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        if x.size and max(int(np.abs(x).max()) * self.n, int(np.abs(self.sums).max())) > MOST_PRODUCT:
            raise OverflowError("n * x does not fit 64 bits")
        return self.n * x - self.sums

    def whitened(self, apart: np.ndarray) -> np.ndarray:
        return (apart / self.n) @ self.v.T / np.sqrt(self.e)


def _rows(batches: Iterator[pa.RecordBatch], model: Whitening, error: float) -> Iterator[pa.RecordBatch]:
    k = len(model.e)
    for batch in batches:
        for at in range(0, batch.num_rows if k else 0, STEP):
            piece = batch.slice(at, STEP)
            apart = model.apart(floors(matrix(piece.column("v")), FACTOR, MOST) + SHIFT)
            if (apart.astype(float) ** 2).sum(axis=1).max() > 2.0**63:
                raise OverflowError("a deviation does not fit 64 bits")
            m = len(apart)
            again = np.repeat(np.arange(m), k)
            yield pa.record_batch(
                [piece.column("vec_id").take(pa.array(again)), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, model.n), (apart * apart).sum(axis=1)[again], model.whitened(apart).ravel(), np.tile(model.e / model.trace, m), np.full(m * k, error)],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )


def whiten(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row with a finite vector and each component.

    The model is fitted on each distinct integer vector once. Components without variance have no whitened value and are left out, so that a table
    of one distinct vector gives no rows. Null and repeated ids are rows as others. All vectors have one length, else ValueError; integers or
    deviations that do not fit 64 bits make an OverflowError. Other columns are ignored; no rows give no rows.
    """
    rows = vectors(df, F.col("vec_id").cast("long").alias("vec_id"))
    fit = stored(mapped(rows.select("v"), _integers, "x binary").distinct(), "whitening-fit")
    state = _tree(fit, decomposed, merged)
    if not state:
        return df.sparkSession.createDataFrame([], _SCHEMA)
    model = Whitening(state[0], components)
    _, _, scatter = _tree(fit, lambda x: _moments(model.whitened(model.apart(x))), _merged_moments)[0]
    error = float(np.abs(scatter / model.n - np.eye(len(model.e))).max()) if len(model.e) else 0.0
    return mapped(rows, lambda b: _rows(b, model, error), _SCHEMA)
