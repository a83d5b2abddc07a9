"""Filters on scores of candidate tokens: rows (group, token, logit) or arrays of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import once


def ranked(rows: DataFrame, group: str, token: str, logit: str, k: int) -> DataFrame:
    """The k best tokens of each group with p (softmax over the group) and rank."""
    w = Window.partitionBy(group)
    e = rows.withColumn("_e", F.exp(F.col(logit) - F.max(logit).over(w)))
    out = e.withColumn("p", F.col("_e") / F.sum("_e").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.col(logit).desc(), token)))
    return out.where(F.col("rank") <= k).drop("_e")


def top_k(rows: DataFrame, group: str, logit: str, k: int) -> DataFrame:
    """Tokens no worse than the k-th: equals of the k-th stay."""
    return rows.withColumn("_r", F.rank().over(Window.partitionBy(group).orderBy(F.col(logit).desc()))).where(F.col("_r") <= k).drop("_r")


def top_p(rows: DataFrame, group: str, token: str, logit: str, p: float, inclusive: bool = True, least: int = 1) -> DataFrame:
    """The best tokens until their probability reaches p. A token stays if what is before it is at most p
    (inclusive) or below p; at least `least` stay."""
    w = Window.partitionBy(group)
    e = rows.withColumn("_e", F.exp(F.col(logit) - F.max(logit).over(w)))
    order = w.orderBy(F.col(logit).desc(), token)
    before = F.round(F.coalesce(F.sum(F.col("_p")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), 9)
    seen = e.withColumn("_p", F.col("_e") / F.sum("_e").over(w)).withColumn("_before", before).withColumn("_rank", F.row_number().over(order))
    return seen.where(((F.col("_before") <= p) if inclusive else (F.col("_before") < p)) | (F.col("_rank") <= least)).drop("_e", "_p", "_before", "_rank")


def minimum_length(logit: Column, token: Column, length: Column, least: int, end: int, low: float = float("-inf")) -> Column:
    return F.when((token == end) & (length < least), F.lit(low)).otherwise(logit)


def repetition_penalty(rows: DataFrame, seen: DataFrame, group: str, token: str, logit: str, penalty: float) -> DataFrame:
    """Logits of tokens that a group has seen: divided by the penalty if positive, multiplied if negative."""
    marked = rows.join(seen.select(group, token).distinct().withColumn("_seen", F.lit(True)), [group, token], "left")
    x = F.col(logit)
    return marked.withColumn(logit, F.when(F.col("_seen"), F.when(x < 0, x * penalty).otherwise(x / penalty)).otherwise(x)).drop("_seen")


def banned_words(ids: Column, sequences: list[list[int]]) -> Column:
    """Last ids of the listed sequences whose other ids end the text."""
    out = F.array().cast("array<bigint>")
    for s in sequences:
        n = len(s) - 1
        ends = F.lit(True) if n == 0 else (F.size(ids) >= n) & (F.slice(ids, F.greatest(F.size(ids) - n + 1, F.lit(1)), F.lit(n)) == F.array(*[F.lit(x).cast("bigint") for x in s[:-1]]))
        out = F.concat(out, F.when(ends, F.array(F.lit(s[-1]).cast("bigint"))).otherwise(F.array().cast("array<bigint>")))
    return out


def banned_by_ngram(ids: Column, n: int) -> Column:
    """Ids that would complete an n-gram that the text has already."""

    def banned(ids: Column, tail: Column) -> Column:
        starts = F.when(F.size(ids) >= n, F.sequence(F.lit(1), F.size(ids) - n + 1)).otherwise(F.array().cast("array<int>"))
        found = F.filter(starts, lambda i: F.slice(ids, i, n - 1) == tail)
        return F.array_distinct(F.transform(found, lambda i: F.element_at(ids, i + (n - 1))))

    return once(ids, lambda x: once(F.slice(x, F.greatest(F.size(x) - n + 2, F.lit(1)), F.lit(n - 1)), lambda tail: banned(x, tail)))


def forced(token: Column, only: int, low: float = float("-inf")) -> Column:
    return F.when(token == only, F.lit(0.0)).otherwise(F.lit(low))


def suppressed(logit: Column, token: Column, tokens: list[int], low: float = float("-inf")) -> Column:
    return F.when(token.isin(*tokens), F.lit(low)).otherwise(logit)


def stops(ids: Column, text: Column, most: int, end: int, strings: list[str]) -> Column:
    """Whether any rule stops: length, end id, or a string in the text."""
    out = (F.size(ids) >= most) | (F.element_at(ids, -1) == end)
    for s in strings:
        out = out | F.contains(text, F.lit(s))
    return out


def _equals(ids: Column, n: int, tail: Column):
    return lambda i: F.slice(ids, i, n) == tail


def prompt_lookup(ids: Column, longest: int, ahead: int) -> Column:
    """What follows the first earlier place of the text's last n ids, for the greatest n that has one."""

    def first(ids: Column, n: int) -> Column:
        tail = F.slice(ids, F.greatest(F.size(ids) - n + 1, F.lit(1)), F.lit(n))
        starts = F.when(F.size(ids) > n, F.sequence(F.lit(1), F.size(ids) - n)).otherwise(F.array().cast("array<int>"))
        at = once(tail, lambda end: F.array_min(F.filter(starts, _equals(ids, n, end))))
        return once(at, lambda k: F.when(k.isNotNull(), F.slice(ids, k + n, ahead)))

    return once(ids, lambda x: F.coalesce(*[first(x, n) for n in range(longest, 0, -1)], F.array().cast("array<bigint>")))


def trie(phrases: DataFrame, words: str) -> DataFrame:
    """prefix, next: the words that follow each prefix of a phrase; no row has a whole phrase that nothing goes on from."""
    p = phrases.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda k: F.struct(F.array_join(F.slice(F.col(words), F.lit(1), k), " ").alias("prefix"), F.element_at(F.col(words), k + 1).alias("w")))).alias("x"))
    return p.groupBy("x.prefix").agg(F.array_sort(F.collect_set("x.w")).alias("next"))


def label_scores(contradiction: Column, entailment: Column, several: bool) -> Column:
    """Scores of labels from their contradiction and entailment logits: softmax of entailment over all labels, or, where several can
    hold, of each label's own two."""
    if several:
        return F.zip_with(contradiction, entailment, lambda c, e: 1 / (1 + F.exp(c - e)))
    most = F.array_max(entailment)
    total = F.aggregate(entailment, F.lit(0.0), lambda s, e: s + F.exp(e - most))
    return F.transform(entailment, lambda e: F.exp(e - most) / total)
