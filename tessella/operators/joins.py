"""Joins that Spark has no operator for, as compositions of those it has. Engine features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each left row with the value of the last right row of its key at or before its time: one sort of both
    sides by key and time instead of a join of all pairs."""
    l = left.withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(dict(right.dtypes)[value]))
    r = right.select(key, time, F.lit(0).alias("_side"), F.col(value).alias("_value"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(w)).where("_side = 1").select(*left.columns, value)


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points with every range [low, high) that holds them: an equi-join on buckets of a width near that of the ranges,
    then the exact predicate. A range stands in every bucket that it touches."""
    p = points.withColumn("_bucket", F.floor(F.col(point) / width))
    r = ranges.where(F.col(low) < F.col(high)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "_bucket").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bucket")
