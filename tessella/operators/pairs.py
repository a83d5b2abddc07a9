"""Sentence pairs for pre-training. Random choices go by hash, so that a run can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .order import with_row_number


def _draw(seed: int, *columns: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])), 1, 8), 16, 10).cast("long")


def segments(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, seg_no, segment: lines of a document joined until they have `words` words."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("i", "line")).where(F.btrim("line") != "")
    before = F.coalesce(F.sum(F.size(tokens(F.col("line")))).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.withColumn("seg", F.floor(before / words))
    whole = placed.groupBy("doc_id", "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), " ").alias("segment"))
    return whole.withColumn("seg_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("seg")) - 1).drop("seg")


def order_pairs(docs: DataFrame, words: int = 128, seed: int = 0) -> DataFrame:
    """doc_id, seg_no, first, second, swapped: neighbours in one document, half of them the other way round."""
    nxt = F.lead("segment").over(Window.partitionBy("doc_id").orderBy("seg_no"))
    pairs = segments(docs, words).withColumn("next", nxt).where("next is not null").withColumn("swapped", _draw(seed, "doc_id", "seg_no") % 2 == 1)
    pick = lambda a, b: F.when(F.col("swapped"), F.col(a)).otherwise(F.col(b))
    return pairs.select("doc_id", "seg_no", pick("next", "segment").alias("first"), pick("segment", "next").alias("second"), "swapped")


def next_pairs(docs: DataFrame, words: int = 128, seed: int = 0) -> DataFrame:
    """doc_id, seg_no, first, second, random: a segment and the next, or for half of them a segment of another
    document. A document's last segment has none of its own and is always paired at random; nothing
    comes of a table with one document."""
    numbered = with_row_number(segments(docs, words), "doc_id", "seg_no", name="row")
    n = numbered.count()
    if n < 2:
        return numbered.select("doc_id", "seg_no", F.col("segment").alias("first"), F.col("segment").alias("second"), F.lit(True).alias("random")).limit(0)
    nxt = F.lead("segment").over(Window.partitionBy("doc_id").orderBy("seg_no"))
    drawn = numbered.withColumn("next", nxt).withColumn("random", F.col("next").isNull() | (_draw(seed, "doc_id", "seg_no") % 2 == 1))
    drawn = drawn.withColumn("other", F.when(F.col("random"), _draw(seed + 1, "doc_id", "seg_no") % n))
    others = numbered.select(F.col("row").alias("other"), F.col("doc_id").alias("other_doc"), F.col("segment").alias("other_segment"))
    joined = drawn.join(others, "other", "left").where("not random or other_doc <> doc_id")
    return joined.select("doc_id", "seg_no", F.col("segment").alias("first"), F.when(F.col("random"), F.col("other_segment")).otherwise(F.col("next")).alias("second"), "random")
