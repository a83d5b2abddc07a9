"""Vector code compression: product quantization in integers, trained by a tree of numpy sums.

Vectors are packed once into stored blocks, column by column. A round is one RDD treeAggregate over the blocks: distances to the
codebook's entries accumulate dimension by dimension, every part goes to its nearest entry, and np.add.at gathers 64-bit sums and
counts, whose size does not hang on the number of vectors. A last pass over the blocks writes the codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import join_about, mapped, stored
from ._vectors import floors, matrix, vectors

#: Parts of a vector, entries of a part's codebook, rounds of training, and the factor of the integers.
PARTS, ENTRIES, ROUNDS, FACTOR = 16, 64, 2, 256
#: Vectors of a block, and of one step inside it.
BLOCK, STEP = 4096, 1024
#: Largest integer of a component: squared distances of 8,192 such components fit 64 bits.
MOST = 1 << 24

Sums = tuple[np.ndarray, np.ndarray]


def _blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors: ids and labels as lists, components as 32-bit integers, one dimension after the other."""
    for batch in batches:
        x = floors(matrix(batch.column("v")), FACTOR, MOST)
        if x.shape[1] % parts or not x.shape[1] and len(x):
            raise ValueError(f"vectors of {x.shape[1]} components cannot be cut into {parts} equal parts")
        for at in range(0, len(x), BLOCK):
            piece = batch.slice(at, BLOCK)
            one = pa.array([0, piece.num_rows], pa.int32())
            columns = [pa.ListArray.from_arrays(one, piece.column(c)) for c in ("vec_id", "label")]
            packed = np.ascontiguousarray(x[at : at + BLOCK].T.astype("<i4")).tobytes()
            yield pa.record_batch([*columns, pa.array([piece.num_rows]), pa.array([packed], pa.binary())], ["vec_id", "label", "n", "block"])


def nearest(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columnar vectors (dimension, vector) against codebooks (part, entry, dimension of the part): the index of each part's nearest
    entry, the lower one of equals, and the squared distances summed over the parts."""
    parts, entries, width = codebooks.shape
    codes, error = np.empty((parts, x.shape[1]), np.int64), np.zeros(x.shape[1], np.int64)
    for at in range(0, x.shape[1], STEP):
        here = slice(at, at + STEP)
        for p in range(parts):
            distance = np.zeros((entries, x[:, here].shape[1]), np.int64)
            for d in range(width):
                apart = x[p * width + d, here] - codebooks[p, :, d, None]
                apart *= apart
                distance += apart
            codes[p, here] = distance.argmin(axis=0)
            error[here] += distance.min(axis=0)
    return codes, error


def _columns(n: int, block: bytes) -> np.ndarray:
    return np.frombuffer(block, "<i4").reshape(-1, n).astype(np.int64)


def _gather(sums: Sums | None, block: tuple[int, bytes], codebooks: np.ndarray) -> Sums:
    """Sums and counts with those of one more block."""
    if sums is None:
        sums = np.zeros(codebooks.shape, np.int64), np.zeros(codebooks.shape[:2], np.int64)
    x = _columns(*block)
    codes, _ = nearest(x, codebooks)
    part = np.arange(len(codes))[:, None]
    np.add.at(sums[1], (part, codes), 1)
    for d in range(codebooks.shape[2]):
        np.add.at(sums[0], (part, codes, d), x[d :: codebooks.shape[2]])
    return sums


def _merge(a: Sums | None, b: Sums | None) -> Sums | None:
    if a is None or b is None:
        return a or b
    return a[0] + b[0], a[1] + b[1]


def refined(codebooks: np.ndarray, sums: Sums) -> np.ndarray:
    """Entries become the floored means of their parts; entries without any stay."""
    count = sums[1][:, :, None]
    return np.where(count > 0, sums[0] // np.maximum(count, 1), codebooks)


def trained(blocks: DataFrame, codebooks: np.ndarray, rounds: int) -> np.ndarray:
    parts = blocks.select("n", "block").rdd.map(lambda r: (r.n, bytes(r.block)))
    for _ in range(rounds):
        sums = parts.treeAggregate(None, lambda acc, block, now=codebooks: _gather(acc, block, now), _merge, depth=2)
        codebooks = refined(codebooks, sums)
    return codebooks


def _coded(batches: Iterator[pa.RecordBatch], codebooks: np.ndarray) -> Iterator[pa.RecordBatch]:
    digits = np.array([f"{k:02x}" for k in range(codebooks.shape[1])], "S2")
    for batch in batches:
        for k in range(batch.num_rows):
            codes, error = nearest(_columns(batch.column("n")[k].as_py(), batch.column("block")[k].as_py()), codebooks)
            text = np.ascontiguousarray(digits[codes].T).view(f"S{2 * len(codes)}").ravel().astype(f"U{2 * len(codes)}")
            yield pa.record_batch([batch.column("vec_id")[k].values, batch.column("label")[k].values, pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])


def vector_codes(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row for each row whose vector has finite components only.

    Components are floor(256 * x). A part's codebook starts as that part of the rows with the `entries` smallest vec_ids (equal ids by their
    vectors, null ids last; fewer rows make a smaller codebook). label_error sums the errors of rows with the same label, null
    being one. Repeated rows count each time. All vectors have one length, a multiple of `parts`, else ValueError;
    components above 65,536 make an OverflowError, as exact sums would not fit. Other columns are ignored; no rows give no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index is written as two hexadecimal digits")
    label = df.schema["label"].dataType.simpleString()
    rows = vectors(df, F.col("vec_id").cast("long").alias("vec_id"), "label")
    first = [r.v for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    result = f"vec_id long, label {label}, code string, error long"
    if not first:
        return df.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    blocks = stored(mapped(rows, lambda b: _blocks(b, parts), f"vec_id array<long>, label array<{label}>, n long, block binary"), "vector-blocks")
    start = floors(matrix(pa.array(first, pa.list_(pa.float64()))), FACTOR, MOST)
    codebooks = trained(blocks, np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2)), rounds)
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    coded = stored(mapped(blocks, lambda b: _coded(b, codebooks), result).withColumn("_none", F.col("label").isNull()).withColumn("_label", F.coalesce(F.col("label").cast("string"), F.lit(""))), "vector-codes")
    about = stored(coded.groupBy("_none", "_label").agg(F.count("*").alias("_n"), F.sum("error").alias("label_error")), "vector-labels")
    total = about.agg(F.sum("_n")).first()[0]
    return join_about(coded, about, ["_none", "_label"], "_n", total).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the same rows."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
d{k} AS (SELECT i, x.p, e, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM x JOIN c{k} USING (p, j) GROUP BY i, x.p, e),
a{k} AS (SELECT i, p, min(d * {entries} + e) % {entries} AS e, min(d * {entries} + e) // {entries} AS d FROM d{k} GROUP BY i, p)""")
        if k < rounds:
            steps.append(f"""
m{k} AS (SELECT p, e, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS z FROM x JOIN a{k} USING (i, p) GROUP BY p, e, j),
c{k + 1} AS (SELECT p, e, j, coalesce(z, y) AS y FROM c{k} LEFT JOIN m{k} USING (p, e, j))""")
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS i, vec_id, label, embedding FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
u AS (SELECT i, unnest(range(len(embedding))) AS k, len(embedding) // {parts} AS w, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM v),
x AS (SELECT i, k // w AS p, k % w AS j, x FROM u),
c0 AS (SELECT p, i AS e, j, x AS y FROM x WHERE i < {entries}),{",".join(steps)},
f AS (SELECT i, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY i),
h AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, j)) AS s FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h.s AS codebooks_sha256 FROM f JOIN v USING (i), h"""
