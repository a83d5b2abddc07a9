"""Shared pieces of the training-data operators: storage, Arrow text buffers, hashing, packed blobs."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Id that stands for a null doc_id inside packed blobs; it sorts before every other id.
NULL_ID = -(2**63)
#: Column that `keyed` adds, and the bits of a row's number in its file.
ROW, FILE_BITS = "_tessella_row", 38
#: Bytes of text that one vectorised step works on.
STEP_BYTES = 1 << 20
#: Bytes of one Arrow batch to or from a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20
#: Text bytes that one partition of a packed shuffle should hold.
PART_BYTES = 12_000_000

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[32, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[0x00:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


# ---------------------------------------------------------------- storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Only a local session, whose executors are the driver, gets a
    temporary one where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow in batches of at most BATCH_BYTES: both the JVM and the Python worker hold several batches at a time.
    The session's own limit stays where it is lower; it is read when the plan runs, so it is not set back."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(partial(_frugal, fn=fn), schema)


def _frugal(batches: Iterator[pa.RecordBatch], fn) -> Iterator[pa.RecordBatch]:
    """fn of the batches; then the worker, which is kept for other tasks and stages, gives what is free back to the machine."""
    yield from fn(batches)
    give_back()


def give_back() -> None:
    """What this process has freed goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _scans_files(df: DataFrame) -> bool:
    """Whether df is columns or rows of one file scan, so that each of its rows has a place in a file."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.toString()


def keyed(df: DataFrame) -> DataFrame:
    """df with ROW: a number of at most 62 bits that no other row has, and that stays the same when the table is read again.
    Ids may be null or repeated, so rows are known by their place: that in the files of a scan, else that in a stored copy."""
    if not _scans_files(df):
        return stored(df.withColumn(ROW, F.monotonically_increasing_id()), "keyed")
    spark, path, place = df.sparkSession, F.col("_metadata.file_path"), F.col("_metadata.row_index")
    files = sorted(r[0] for r in df.select(path).distinct().collect())  # no more than the scan's own list of files
    if len(files) == 1:
        return df.withColumn(ROW, place)
    table = spark.createDataFrame([(f, k << FILE_BITS) for k, f in enumerate(files)], f"{ROW}_file string, {ROW}_first long")
    placed = df.withColumn(ROW, place).withColumn(f"{ROW}_file", path).join(F.broadcast(table), f"{ROW}_file", "left")
    return placed.withColumn(ROW, F.col(ROW) + F.col(f"{ROW}_first")).drop(f"{ROW}_file", f"{ROW}_first")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def partitions_for(spark: SparkSession, n_bytes: int, part_bytes: int = PART_BYTES) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // part_bytes))


#: Keys with more than one row in so many are hot: there can be no more of them than this, so a table of them may be broadcast.
HOT_KEYS = 4096


def join_about(rows: DataFrame, about: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """rows left join about, which has one row for each key with the number of its rows in `count`, of `total` rows in all.

    Hot keys are looked up in a broadcast table of at most HOT_KEYS rows, so that none of them is one task; others are shuffled.
    """
    extra = [c for c in about.columns if c not in keys and c != count]
    hot = F.col(count) > total // HOT_KEYS
    table = about.where(hot).select(*keys, *extra, F.lit(True).alias("_is_hot"))
    near = rows.join(F.broadcast(table), keys, "left")
    rest = near.where("_is_hot is null").select(*rows.columns).join(about.where(~hot).drop(count), keys, "left")
    return near.where("_is_hot").select(*rows.columns, *extra).unionByName(rest.select(*rows.columns, *extra))


# ---------------------------------------------------------------- hashing


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=U64)


_BYTE = _random(256, 1) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters all bits."""
    with np.errstate(over="ignore"):
        x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def scaled(h: np.ndarray, n) -> np.ndarray:
    """Hashes to numbers below n, keeping their order."""
    return ((h >> U64(32)) * np.asarray(n, U64)) >> U64(32)


_powers = np.ones(1, U64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 256)
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(np.full(size, _BASE, U64))
    return _powers


class Words:
    """Words of a run of texts: byte bounds, text number and 64-bit hash of each, in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, fold: bool = False):
        self.data = data = FOLD[data] if fold else data
        self.offsets = offsets
        inside = ~separators[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.bound = np.searchsorted(self.start, offsets)  # words of text i: bound[i] to bound[i + 1]
        self.count = np.diff(self.bound)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), U64)
        done = 0
        while done < len(out):
            low = self.start[done]
            upto = max(done + 1, int(np.searchsorted(self.end, low + STEP_BYTES, "right")))
            s = self.start[done:upto]
            length = self.end[done:upto] - s
            first = np.cumsum(length) - length
            place = np.arange(int(length.sum())) - np.repeat(first, length)
            at = place + np.repeat(s, length)
            with np.errstate(over="ignore"):
                out[done:upto] = np.add.reduceat(_BYTE[self.data[at]] * _power(int(length.max()))[place], first)
            done = upto
        return mix(out)

    def windows(self, h: np.ndarray, size: int) -> np.ndarray:
        """Rabin-Karp hash of every run of `size` words, also of those that cross from one text to the next."""
        n = max(0, len(h) - size + 1)
        out = np.zeros(n, U64)
        with np.errstate(over="ignore"):
            for k in range(size):
                out = out * _BASE + h[k : k + n]
        return mix(out, size)


# ---------------------------------------------------------------- Arrow text


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, or one longer text."""
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


# ---------------------------------------------------------------- packed blobs


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, without the planes that are zero; lz4 in the shuffle takes the rest."""
    parts = [np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()]
    for a in arrays:
        planes = np.ascontiguousarray(a.astype(U64).view(np.uint8).reshape(-1, 8).T)
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        parts += [bytes([width]), planes[:width].tobytes()]
    return b"".join(parts)


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, n, 8)
    at, out = 8 + 8 * n, []
    for size in sizes.tolist():
        width = blob[at]
        planes = np.zeros((8, size), np.uint8)
        planes[:width] = np.frombuffer(blob, np.uint8, width * size, at + 1).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(U64).reshape(-1))
        at += 1 + width * size
    return out


def up(a: np.ndarray) -> tuple[int, np.ndarray]:
    """Signed numbers as their least one and unsigned distances from it."""
    low = int(a.min()) if len(a) else 0
    return low, (a.astype(np.int64).view(U64) - np.array([low], np.int64).view(U64)[0])


def down(low: int, a: np.ndarray) -> np.ndarray:
    return (a + np.array([low], np.int64).view(U64)[0]).view(np.int64)


def deltas(a: np.ndarray) -> np.ndarray:
    """Differences of sorted unsigned numbers."""
    out = a.copy()
    out[1:] -= a[:-1]
    return out


# ---------------------------------------------------------------- membership filters


class SlotFilter:
    """A filter over keys, as a bitmap of 2^LEAST_LOG2 to 2^MOST_LOG2 bits (at most 64 MB), sized by the number of keys. It never misses
    a key that is in it; others pass by chance, so that callers use it to move less and not to decide."""

    LEAST_LOG2, MOST_LOG2 = 20, 29

    def __init__(self, keys: DataFrame, *columns: str):
        known = stored(keys.where(F.greatest(*[F.col(c).isNotNull() for c in columns]) if len(columns) > 1 else F.col(columns[0]).isNotNull()).select(F.xxhash64(*columns).alias("hash")), "slot-keys")
        self.columns = columns
        self.bits = 1 << min(self.MOST_LOG2, max(self.LEAST_LOG2, (16 * known.count()).bit_length()))
        slots = known.select(F.pmod("hash", F.lit(self.bits)).alias("slot"))
        maps = slots.groupBy(F.bitmap_bucket_number("slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bitmap"))
        self.table = stored(maps, "slots")  # 4 KB for each of at most bits / 32768 buckets

    def mark(self, df: DataFrame, name: str, *columns: str) -> DataFrame:
        """df with a column that is true where the key may be in the filter, else false."""
        slot = F.pmod(F.xxhash64(*(columns or self.columns)), F.lit(self.bits))
        bit = F.bitmap_bit_position(slot)
        byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hit = F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1
        return df.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(self.table), "_bucket", "left").withColumn(name, F.coalesce(hit, F.lit(False))).drop("_bucket", "_bitmap")

    def keep(self, df: DataFrame, *columns: str) -> DataFrame:
        return self.mark(df, "_may_be", *columns).where("_may_be").drop("_may_be")
