"""A smoothed language model of words, counted in Spark, and perplexities by it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.procedural import word_slices
from .storage import stored

#: What stands before the first word of a text; no word holds a space.
START = "< >"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for words in word_slices(batch.column("w")):
            coded = words.flatten().dictionary_encode()
            known = pa.concat_arrays([coded.dictionary, pa.array([START], coded.dictionary.type)])
            word, size = coded.indices.to_numpy().astype(np.int64), pc.list_value_length(words).to_numpy()
            before = np.concatenate([[0], word[:-1]]) if len(word) else word
            before[np.cumsum(size) - size] = len(known) - 1  # no row is without words
            row = np.repeat(np.arange(len(size)), size)
            pair, n = np.unique((row * len(known) + before) * len(known) + word, return_counts=True)
            ids = batch.column("id").slice(at, len(words)).take(pa.array(pair // len(known) ** 2))
            yield pa.record_batch([ids, known.take(pa.array(pair // len(known) % len(known))), known.take(pa.array(pair % len(known))), pa.array(n.astype(np.int64))], ["id", "before", "word", "n"])
            at += len(words)


def word_pairs(docs: DataFrame, id_col: str, words: Column) -> DataFrame:
    """id, before, word, n: the pairs of each row's text, counted where it is read, so that a pair that stands everywhere is one row of a text and
    nothing is shuffled."""
    rows = docs.select(F.col(id_col).alias("id"), words.alias("w")).where(F.size("w") > 0)
    return rows.mapInArrow(_counted, f"id {rows.schema['id'].dataType.simpleString()}, before string, word string, n long")


def _discounts(seen: DataFrame) -> list[float]:
    """What is taken from pairs that were seen once, twice and more often."""
    times = {r.n: r["count"] for r in seen.where("n <= 4").groupBy("n").count().collect()}
    kinds = [times.get(k, 0) for k in range(5)]
    y = kinds[1] / (kinds[1] + 2 * kinds[2]) if kinds[1] else 0.0
    return [k - (k + 1) * y * kinds[k + 1] / kinds[k] if kinds[k] else 0.0 for k in (1, 2, 3)]


def _discount(three: list[float]) -> Column:
    return F.element_at(F.array(*map(F.lit, three)), F.least(F.col("n"), F.lit(3)).cast("int"))


class KneserNey:
    """A model of pairs of words with three discounts, for pairs seen once, twice and more often (S. F. Chen and J. Goodman, An empirical study of
    smoothing techniques for language modeling, 1998). What a word's pairs are discounted by is shared by how many different words a word follows.

    `table` has before, word, p for every pair that was seen; a pair that was not has backing(before) * spread(word).
    """

    def __init__(self, pairs: DataFrame):
        seen = stored(pairs.groupBy("before", "word").agg(F.sum("n").alias("n")), "pair-counts")
        self.discounts = _discounts(seen)
        discount = _discount(self.discounts)
        self.backing = stored(seen.groupBy("before").agg(F.sum("n").alias("total"), (F.sum(discount) / F.sum("n")).alias("share")), "pair-contexts")
        different = seen.count()
        self.spread = stored(seen.groupBy("word").agg((F.count("*") / F.lit(float(max(1, different)))).alias("spread")), "pair-words")
        own = (F.col("n") - discount) / F.col("total") + F.col("share") * F.col("spread")
        self.table = seen.join(self.backing, "before").join(self.spread, "word").select("before", "word", own.alias("p"))

    def scores(self, pairs: DataFrame) -> DataFrame:
        """id, n_words, nll, perplexity. A pair that the model has not seen is backed off; a text with a word that it does not know at all has no
        finite score."""
        known = pairs.join(self.table, ["before", "word"], "left")
        rest = known.where("p is null").drop("p").join(self.backing, "before", "left").join(self.spread, "word", "left")
        backed = rest.select("id", "before", "word", "n", (F.coalesce("share", F.lit(1.0)) * F.coalesce("spread", F.lit(0.0))).alias("p"))
        every = known.where("p is not null").select("id", "before", "word", "n", "p").unionByName(backed)
        cost = F.when(F.col("p") > 0, -F.log("p")).otherwise(F.lit(float("inf")))
        summed = every.groupBy("id").agg(F.sum("n").alias("n_words"), F.sum(F.col("n") * cost).alias("nll"))
        return summed.select("id", "n_words", "nll", F.exp(F.col("nll") / F.col("n_words")).alias("perplexity"))


#: Rows of pairs that a worker sums up before they are shuffled.
SUM_ROWS = 1 << 20


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def summed() -> Iterator[pa.RecordBatch]:
        made = pa.Table.from_batches(held).group_by(["before", "word"], use_threads=False).aggregate([("n", "sum")])
        return iter(made.select(["before", "word", "n_sum"]).rename_columns(["before", "word", "n"]).to_batches())

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= SUM_ROWS:
            yield from summed()
            held, size = [], 0
    if size:
        yield from summed()


def own_scores(pairs: DataFrame) -> DataFrame:
    """id, n_words, nll, perplexity of every text by the model of all of them: KneserNey(pairs).scores(pairs), where nothing is backed off, with less to
    move. Words go by 64-bit hashes and so do pairs where the texts' pairs meet the model, which is once; no word is shuffled or stored. Counts
    are dealt by word, so that how many words it follows is known where they arrive, and once more by the word before, where the rest is.
    """
    coded = pairs.select("id", F.xxhash64("before").alias("before"), F.xxhash64("word").alias("word"), "n")
    summed = coded.select("before", "word", "n").mapInArrow(_summed, "before long, word long, n long")
    seen = summed.repartition("word").groupBy("before", "word").agg(F.sum("n").alias("n"))
    seen = stored(seen.withColumn("follows", F.count("*").over(Window.partitionBy("word"))), "pair-counts")
    discount, different = _discount(_discounts(seen)), seen.count()
    pair = F.xxhash64("before", "word").alias("pair")
    own = Window.partitionBy("before")
    total, kept = F.sum("n").over(own), F.sum(discount).over(own)
    p = (F.col("n") - discount + kept * F.col("follows") / F.lit(float(max(1, different)))) / total
    table = seen.select("before", pair, "n", "follows").select("pair", (-F.log(p)).alias("cost"))
    joined = coded.select("id", pair, "n").join(table, "pair")
    summed = joined.groupBy("id").agg(F.sum("n").alias("n_words"), F.sum(F.col("n") * F.col("cost")).alias("nll"))
    return summed.select("id", "n_words", "nll", F.exp(F.col("nll") / F.col("n_words")).alias("perplexity"))
