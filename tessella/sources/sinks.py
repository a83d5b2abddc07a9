"""Sinks: columnar data sets, JSON, hits and n-gram tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one JSON Lines file.
ROWS_A_FILE = 1_000_000
#: Rows that may be written as one pretty JSON file by the driver.
SMALL_ROWS = 100_000


def save_columnar(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def from_records(spark: SparkSession, records: list[dict], schema: str | None = None) -> DataFrame:
    return spark.createDataFrame(records, schema=schema)


def save_json_lines(df: DataFrame, path: str, id_col: str, text_col: str, rows: int = ROWS_A_FILE) -> None:
    """{id, contents} lines in files of at most `rows`; no rows give an empty folder."""
    df.select(F.col(id_col).alias("id"), F.col(text_col).alias("contents")).write.mode("overwrite").option("maxRecordsPerFile", rows).json(path)


def save_json_array(df: DataFrame, path: str) -> None:
    """One indented array with non-ASCII characters kept, for small results: more than SMALL_ROWS is an error."""
    import json

    rows = df.limit(SMALL_ROWS + 1).toJSON().collect()
    if len(rows) > SMALL_ROWS:
        raise ValueError(f"more than {SMALL_ROWS} rows; write JSON Lines instead")
    text = json.dumps([json.loads(r) for r in rows], indent=4, ensure_ascii=False)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_hits(hits: DataFrame, path: str) -> None:
    """qid, pid, rank, score, tab-separated, each query's hits together by rank."""
    hits.select("qid", "pid", "rank", "score").repartition("qid").sortWithinPartitions("qid", "rank").write.mode("overwrite").csv(path, sep="\t")


def save_ngrams(counts: DataFrame, path: str) -> None:
    """ngram, count, most frequent first."""
    counts.select("ngram", "cnt").orderBy(F.col("cnt").desc(), "ngram").write.mode("overwrite").csv(path, sep="\t")


def save_vectors(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
    """An index is a table of ids and vectors; searches read it as it is."""
    vectors.select(id_col, vector_col).write.mode("overwrite").parquet(path)


def cached_table(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at a path, built once. A build that did not finish has no _SUCCESS mark and is built again."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        save_columnar(build(), path)
    return spark.read.parquet(path)
