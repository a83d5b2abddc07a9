"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each round keeps only the groups that still hold two rows. What is left of a round goes to the executors as a
bitmap, sized by the number of such groups up to a fixed bound; a row that meets a bit by chance is refined once
more than needed and still grouped by its whole key. Texts never cross the network: only lengths and hashes do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ROW, SlotFilter, join_about, keyed, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PREFIX_CHARS = 128


def normalised(text: Column) -> Column:
    """A to Z in lower case, all else unchanged; null is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def _survivors(rows: DataFrame, *keys: str) -> SlotFilter:
    """Keys that two rows share at least."""
    return SlotFilter(rows.groupBy(*keys).agg(F.count("*").alias("_rows")).where("_rows > 1"), *keys)


def exact_dedup(docs: DataFrame, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and, with digest, text_sha256 of every normalised text: one row for
    each input row, dropped ones too.

    Texts are equal when identical after lower-casing A-Z; null equals empty. The largest doc_id of a group
    stays. Rows that repeat a doc_id and its text count in group_size and share the flag. A null doc_id
    stays only if its whole group has none. Other columns are ignored; no rows give no rows.
    """
    return _grouped(docs, digest, id_col, text_col, [])


def _grouped(docs: DataFrame, digest: bool, id_col: str, text_col: str, rows: list[str]) -> DataFrame:
    base = docs.select(*rows, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    sized = base.withColumn("_bytes", F.octet_length(F.coalesce("_text", F.lit(""))))
    prefix = F.when(F.col("_same_length"), F.xxhash64(normalised(F.substring("_text", 1, PREFIX_CHARS))))
    prefixed = _survivors(sized, "_bytes").mark(sized, "_same_length").withColumn("_prefix", prefix)
    refined = _survivors(prefixed.where("_same_length"), "_bytes", "_prefix").mark(prefixed, "_same_prefix")
    full = F.when(F.col("_same_length") & F.col("_same_prefix"), F.sha2(normalised(F.col("_text")), 256))
    hashed = stored(refined.select(*rows, "doc_id", "_bytes", full.alias("_full"), *[F.sha2(normalised(F.col("_text")), 256).alias("text_sha256")] * digest), "dedup-hashes")
    groups = hashed.where("_full is not null").groupBy("_bytes", "_full").agg(F.max("doc_id").alias("_keep"), F.count("*").alias("_size")).where("_size > 1")
    groups = stored(groups.withColumn("_rows", F.col("_size")), "dedup-groups")
    return join_about(hashed, groups, ["_bytes", "_full"], "_rows", hashed.count()).select(
        *rows,
        "doc_id",
        F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_size").isNull() | F.col("doc_id").eqNullSafe(F.col("_keep"))).alias("kept"),
        *["text_sha256"] * digest,
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text stays, with all their columns. Each row is judged by itself, also where its id is null or repeated."""
    rows = keyed(docs)
    gone = _grouped(rows, False, id_col, text_col, [ROW]).where("not kept").select(ROW)
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)
