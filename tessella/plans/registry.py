"""Named queries: a name stands for a function of (spark, sf_dir) and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; a name can be used once."""

    def put(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes up to which a table of a few files is dealt anew; larger ones have row groups enough to be read in parallel.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where it is a small table in fewer files than there are cores, for work that is heavy on each row: a file
    with one row group is read by one task. Any other table stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL_BYTES and len(df.inputFiles()) < cores else df
