"""Numbering, sharding and splitting without gathering a table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def with_row_number(df: DataFrame, key: str, *ties: str, name: str = "row_id", parts: int | None = None) -> DataFrame:
    """Numbers from 0 in order of a key and ties, nulls first. Rows are dealt into ranges of the key and the ties together, so that a key which
    many rows share is several tasks', and sorted there; a row's number is its place in its range and the rows of the ranges
    before, of which there is one small row each. The ranges are stored, as Spark may cut them elsewhere the next time."""
    order = [F.col(c).asc_nulls_first() for c in (key, *ties)]
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ranges")
    ranged = ranged.withColumn("_range", F.shiftright("_place", 33))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_count"))
    before = counts.select("_range", (F.sum("_count").over(Window.orderBy("_range")) - F.col("_count")).alias("_before"))  # a row for each range
    number = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(before), "_range").withColumn(name, number).drop("_range", "_before", "_place")


def shard_rest_to_last(row: Column, n: Column | int, shards: int) -> Column:
    """Contiguous shards of n div shards rows, the rest in the last."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.least(F.floor(row / F.greatest(F.floor(n / shards), F.lit(1))), F.lit(shards - 1)).cast("int")


def shard_balanced(row: Column, n: Column | int, shards: int) -> Column:
    """Contiguous shards whose sizes differ by one at most, the larger ones first."""
    n = F.lit(n) if isinstance(n, int) else n
    base, extra = F.floor(n / shards), n % shards
    large = extra * (base + 1)
    return F.when(row < large, F.floor(row / (base + 1))).otherwise(extra + F.floor((row - large) / F.greatest(base, F.lit(1)))).cast("int")


def round_robin(row: Column, batch: int, workers: int) -> Column:
    """Batches of rows in turn to the workers."""
    return F.pmod(F.floor(row / batch), F.lit(workers)).cast("int")


def batch_number(row: Column, size: int) -> Column:
    return F.floor(row / size).cast("long")


def hash_split(key: Column, test_share: float = 0.2, seed: int = 0) -> Column:
    """"test" or "train" by hash: the same for a key at every run and size."""
    place = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long")
    return F.when(F.pmod(place, F.lit(10_000)) < round(test_share * 10_000), "test").otherwise("train")


def concatenated(*frames: DataFrame, name: str = "origin") -> DataFrame:
    """Union by name with the number of the frame that each row is from; missing columns are null."""
    out = None
    for k, df in enumerate(frames):
        df = df.withColumn(name, F.lit(k))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
