"""Token-ID output: Parquet list columns with controlled encodings, row groups and page indexes.

A store has one data set of token lists, in doc_id order within range partitions, and one small data set of
metadata (document, first place, length), so that either is read without the other. Ids are dictionary-encoded
(they repeat) and metadata delta-encoded (they rise); small pages with column indexes let a reader skip to
the documents it wants.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import ROW, buffers, keyed, mapped, partitions_for, shared_dir, steps, text_bytes
from .token_encoder import Encoder

END_ID = 1
#: Parquet writer settings: rows groups and pages by size, dictionary pages for ids, delta encoding for metadata.
TOKEN_OPTIONS = {"compression": "zstd", "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20)}
META_OPTIONS = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "parquet.page.row.count.limit": "5000"}
#: Bytes of text that are encoded together.
ENCODE_BYTES = 1 << 20


_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _tokenize(batches: Iterator[pa.RecordBatch], path: str, end_id: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path, end_id)
    for batch in batches:
        for step in steps(batch, most=ENCODE_BYTES):
            ids, size = encoder.encode(*buffers(step.column("text")))
            cut = np.concatenate([[0], np.cumsum(size)])
            tokens = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.view(np.int32), pa.int32()))
            yield pa.record_batch([*(step.column(c) for c in keep), pa.array(size, pa.int64()), tokens], [*keep, "n_tokens", "tokens"])


class TokenStore:
    """Reads a store's token lists or its metadata, each without the other."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def tokens(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/tokens")

    def metadata(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/metadata")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, keep: tuple[str, ...] = ()) -> TokenStore:
    """Encode every whole text, append end_id, and write the store in ascending doc_id order.

    A null text is empty: only the end id. A null doc_id comes first. Rows that share a doc_id, or have none, follow one
    another as they stand in the table. `keep` names other columns to store with the tokens. No rows give an empty store.
    """
    spark = docs.sparkSession
    base = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep))
    parts = partitions_for(spark, text_bytes(base))
    order = [F.col("doc_id").asc_nulls_first(), F.col(ROW).asc()]  # the row splits ids that many rows share
    placed = base.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = ["doc_id", *keep]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in placed.select(*kept).schema) + "n_tokens long, tokens array<int>"
    rows = mapped(placed.select("doc_id", "text", *keep), lambda b: _tokenize(b, tokenizer_path, end_id, kept), schema)
    rows.withColumn("row_id", F.monotonically_increasing_id()).write.options(**TOKEN_OPTIONS).parquet(f"{path}/tokens")
    store = TokenStore(spark, path)
    # row_id is partition * 2^33 + row, and partitions follow one another: a document starts at its partition's
    # start plus what is before it there.
    lengths = store.tokens().select("doc_id", "n_tokens", "row_id", F.shiftright("row_id", 33).alias("part"))
    totals = lengths.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))  # one row for each partition
    order = Window.partitionBy("part").orderBy("row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = lengths.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.sum("n_tokens").over(order) - F.col("n_tokens")).alias("start"), "n_tokens", "row_id")
    starts.sortWithinPartitions("row_id").write.options(**META_OPTIONS).parquet(f"{path}/metadata")
    return store


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("tokens")
        ids, cut = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        yield pa.record_batch([batch.column("row_id"), pa.array(crc, pa.int64())], ["row_id", "ids_crc32"])


def token_digest(store: TokenStore) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each stored row, all from the files."""
    crc = mapped(store.tokens().select("row_id", "tokens"), _crc, "row_id long, ids_crc32 long")
    return store.metadata().join(crc, "row_id").select("doc_id", "start", "n_tokens", "ids_crc32")


def new_store_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessella/tokens-{uuid.uuid4().hex}"
