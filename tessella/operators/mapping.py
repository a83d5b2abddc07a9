"""Python callbacks over rows, for what no expression says: Arrow batches, lazily, partition by partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn of each batch of rows; it runs when the result is used."""

    def run(batches):
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def map_rows(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """fn of each row as a dict; slower than map_batches, which it rests on."""
    return map_batches(df, lambda pdf: pd.DataFrame([fn(r) for r in pdf.to_dict("records")]), schema)


def filter_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Rows for which fn of their batch is true."""
    return map_batches(df, lambda pdf: pdf[fn(pdf).astype(bool)], df.schema)


def map_halving(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 4096) -> tuple[DataFrame, Accumulator]:
    """fn of batches of at most `rows` rows, and a counter of halvings. Where fn runs out of memory its batch is halved and tried again, down to
    single rows; the size that worked is kept for the rest of the partition. A single row that fails fails its task."""
    halvings = df.sparkSession.sparkContext.accumulator(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = rows
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                try:
                    made = fn(batch.slice(at, size))
                except (MemoryError, pa.ArrowMemoryError):
                    if min(size, batch.num_rows - at) == 1:
                        raise
                    size = max(1, min(size, batch.num_rows - at) // 2)
                    halvings.add(1)
                    pa.default_memory_pool().release_unused()
                    continue
                yield made
                at += size

    return df.mapInArrow(run, schema), halvings


def run_files(spark: SparkSession, source: str, target: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> None:
    """Read any known format, apply fn, write Parquet."""
    from ..sources.readers import read_any
    from ..sources.sinks import save_columnar

    save_columnar(map_batches(read_any(spark, source), fn, schema), target)
