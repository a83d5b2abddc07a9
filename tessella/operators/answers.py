"""Answers from scored spans: features of an example with their results, n-best lists, the empty answer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.procedural import word_slices
from .sequences import span_candidates
from .storage import stored

#: What an example without any valid span answers in its n-best list.
NO_ANSWER = "empty"


def context_features(docs: DataFrame, id_col: str, words_col: str, size: int, stride: int) -> DataFrame:
    """id, feature, tokens, is_max: windows of `size` words, `stride` apart, until one reaches the end, each behind a mark of its own at token 0.

    is_max has, for each token, whether this window shows its word with the most context: the smaller number of words on either
    side, and a hundredth of the window's length; of equal windows the first.
    """
    words = F.col(words_col)
    n = F.size(words)
    count = F.when(n > 0, F.greatest(F.ceil((n - size) / F.lit(stride)), F.lit(0)) + 1).otherwise(0).cast("int")
    rows = docs.select(F.col(id_col).alias("id"), words.alias("_w"), n.alias("_n"), count.alias("_count")).where("_count > 0")
    # Only a window's own words go into its row: a text's words, copied for each of its windows, would grow as the square of its length.
    cut = F.transform(F.sequence(F.lit(0), F.col("_count") - 1), lambda f: F.struct(f.alias("feature"), F.slice("_w", f * stride + 1, F.lit(size)).alias("part")))
    rows = rows.select("id", "_n", "_count", F.explode(cut).alias("_f")).select("id", "_n", "_count", "_f.feature", "_f.part")
    rows = rows.select("id", "feature", F.concat(F.array(F.lit("[CLS]")), F.col("part")).alias("tokens"), "_n", "_count")
    return rows.mapInArrow(_shown_best(size, stride), f"id {rows.schema['id'].dataType.simpleString()}, feature int, tokens array<string>, is_max array<boolean>")


def _spread(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in it of each element of rows of these sizes, one row after the other."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


def _shown_best(size: int, stride: int):
    """Adds is_max to windows that know the words of their text and how many windows it has."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for tokens in word_slices(batch.column("tokens")):
                part = batch.slice(at, len(tokens))
                at += len(tokens)
                feature, n, count = (part.column(c).to_numpy().astype(np.int64) for c in ("feature", "_n", "_count"))
                held = pc.list_value_length(tokens).to_numpy().astype(np.int64)
                row, place = _spread(held)
                own = place > 0
                f, n, count, k = feature[row], n[row], count[row], (feature * stride)[row] + place - 1

                def context(g):
                    length = np.minimum(size, n - g * stride)
                    return np.minimum(k - g * stride, length - 1 - (k - g * stride)) + 0.01 * length

                mine = context(f)
                low, high = np.maximum(0, (k - size) // stride + 1), np.minimum(count - 1, k // stride)
                for step in range(1, (size - 1) // stride + 1):
                    own &= (f - step < low) | (context(f - step) < mine)
                    own &= (f + step > high) | (context(f + step) <= mine)
                shown = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32()), pa.array(own))
                yield pa.record_batch([part.column("id"), part.column("feature"), tokens, shown], ["id", "feature", "tokens", "is_max"])

    return marked


def feature_results(features: DataFrame, results: DataFrame) -> DataFrame:
    """Features with their start_logits and end_logits, by id and feature; a feature without a result, and a result without a feature, is left out."""
    return features.join(results.select("id", "feature", "start_logits", "end_logits"), ["id", "feature"])


def _best(logits: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place, value and rank of the n greatest values of each row, earlier ones first among equals; null ones are NaN, and those come last."""
    value = logits.flatten().to_numpy(zero_copy_only=False)
    size = pc.fill_null(pc.list_value_length(logits), 0).to_numpy().astype(np.int64)
    row, place = _spread(size)
    order = np.lexsort((-value, row))
    order = order[place < n]  # rows stay as they are, so a place in the order is a rank
    return row[order], place[order], value[order], place[place < n]


def _joined(tokens: pa.Array, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The tokens of a row from start to end with spaces between; null ones are left out."""
    first = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())]).astype(np.int64)
    span, place = _spread(end - start + 1)
    taken = tokens.flatten().take(pa.array((first[row] + start)[span] + place))
    if taken.null_count:
        span, taken = span[taken.is_valid().to_numpy(zero_copy_only=False)], taken.drop_null()
    upto = np.concatenate([[0], np.cumsum(np.bincount(span, minlength=len(row)))])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), taken), " ")


def _spans(n: int, longest: int):
    """id, text, neg, feature, i, j, start_logit, end_logit: of the rows of an example that come together its n best spans with different texts, and the
    best one without text; and, with a null text, the empty answer of each feature. Places among the n best are i and j."""

    def found(part: pa.RecordBatch) -> Iterator[list]:
        tokens, own = part.column("tokens"), part.column("is_max")
        none = pa.nulls(len(part), pa.int32())
        yield [part.column("id"), pa.nulls(len(part), pa.string()), pa.nulls(len(part), pa.float64()), part.column("feature"), none, none, part.column("_start"), part.column("_end")]
        held = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
        marks = pc.fill_null(pc.list_value_length(own), 0).to_numpy().astype(np.int64)
        mark = np.append(pc.fill_null(own.flatten(), False).to_numpy(zero_copy_only=False), False)
        row, start, value, i = _best(part.column("start_logits"), n)
        good = (start > 0) & (start < np.minimum(held, marks)[row])
        good &= mark[np.where(good, (np.cumsum(marks) - marks)[row] + start, -1)]
        row, start, value, i = row[good], start[good], value[good], i[good]
        to, end, other, j = _best(part.column("end_logits"), n)
        many = np.bincount(to, minlength=len(part))
        each, step = _spread(many[row])
        pair = (np.cumsum(many) - many)[row[each]] + step
        good = (end[pair] >= start[each]) & (end[pair] < held[row[each]]) & (end[pair] - start[each] < longest)
        each, pair = each[good], pair[good]
        if not len(each):
            return
        row, first, last, i, j = row[each], value[each], other[pair], i[each], j[pair]
        text = _joined(tokens, row, start[each], end[pair])
        neg, feature = -(first + last).astype(np.float64), part.column("feature").to_numpy()[row]
        who = pc.dictionary_encode(part.column("id"), null_encoding="encode").indices.to_numpy()[row].astype(np.int64)
        coded = text.dictionary_encode()
        order = np.lexsort((j, i, feature, neg, who))
        key = (who * len(coded.dictionary) + coded.indices.to_numpy())[order]
        order = order[np.sort(np.unique(key, return_index=True)[1])]  # a text's best span
        _, size = np.unique(who[order], return_counts=True)
        bare = pc.equal(text.take(pa.array(order)), "").to_numpy(zero_copy_only=False)
        kept = pa.array(order[(_spread(size)[1] < n) | bare])
        row = pa.array(row).take(kept)
        yield [part.column("id").take(row), text.take(kept), pa.array(neg).take(kept), part.column("feature").take(row), pa.array(i, pa.int32()).take(kept), pa.array(j, pa.int32()).take(kept), pa.array(first).take(kept), pa.array(last).take(kept)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in word_slices(batch.column("tokens")):
                for columns in found(batch.slice(at, len(some))):
                    yield pa.record_batch(columns, ["id", "text", "neg", "feature", "i", "j", "start_logit", "end_logit"])
                at += len(some)

    return cut


def answers(scored: DataFrame, n: int = 20, longest: int = 30, with_null: bool = True, threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """n-best and predictions of every example that has a scored feature.

    scored: id, feature, tokens, is_max, start_logits, end_logits; token 0 stands for no answer, the others are words of the example.
    A feature offers spans from its n best starts to its n best ends that begin where the feature shows the word best, run forward and have at
    most `longest` tokens. The best n different texts of all features make the list; the empty answer is that of the feature with the least
    score for it, and is put behind the list where it is not among the n. Equal scores go by feature, start and end.

    The first table has id, rank, text, probability, start_logit, end_logit; the second id, prediction, score_null, score_diff: the prediction is empty
    where the empty answer beats the best other one by more than `threshold`. Examples that have no answer but the empty one are not predicted.
    """
    kind = {c: scored.schema[c].dataType.simpleString() for c in ("id", "feature")} | {c: scored.schema[c].dataType.elementType.simpleString() for c in ("start_logits", "end_logits")}
    shape = f"id {kind['id']}, text string, neg double, feature {kind['feature']}, i int, j int, start_logit {kind['start_logits']}, end_logit {kind['end_logits']}"
    rows = scored.select("id", "feature", "tokens", "is_max", "start_logits", "end_logits", F.get("start_logits", F.lit(0)).alias("_start"), F.get("end_logits", F.lit(0)).alias("_end"))
    # Only what can be in a list is stored: neither tokens nor logits are stored or shuffled.
    made = stored(rows.mapInArrow(_spans(n, longest), shape), "answer-spans")
    found = made.where("text is not null").select("id", "text", F.struct("neg", "feature", "i", "j", "start_logit", "end_logit").alias("_x"))
    nulls = made.where("text is null")
    null = nulls.groupBy("id").agg(F.min(F.struct((F.col("start_logit") + F.col("end_logit")).alias("score"), "feature", F.struct(F.col("start_logit").alias("start"), F.col("end_logit").alias("end")).alias("none"))).alias("_null"))
    empty = F.struct((-F.col("_null.score")).alias("neg"), F.lit(2**31 - 1).alias("feature"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("_null.none.start").alias("start_logit"), F.col("_null.none.end").alias("end_logit"))
    every = found.unionByName(null.select("id", F.lit("").alias("text"), empty.alias("_x"))) if with_null else found
    once = every.groupBy("id", "text").agg(F.min("_x").alias("_x"))  # a text's best span, found map-side first
    rank = F.row_number().over(Window.partitionBy("id").orderBy("_x"))
    ranked = stored(once.select("id", "text", "_x.*", rank.alias("rank")).where((F.col("rank") <= n) | (F.col("text") == "")), "ranked-answers")
    ranked = ranked.select("id", "rank", "text", "start_logit", "end_logit")
    # An example with nothing but the empty answer, or without any, has one more that stands for none.
    others = ranked.groupBy("id").agg(F.max(F.when(F.col("text") != "", 1)).alias("_any")).where("_any is not null")
    alone = nulls.select("id").distinct().join(others, "id", "left_anti").select("id", F.lit(0).alias("rank"), F.lit(NO_ANSWER).alias("text"), F.lit(0.0).alias("start_logit"), F.lit(0.0).alias("end_logit"))
    listed = ranked.unionByName(alone)
    place = Window.partitionBy("id").orderBy("rank")
    total = F.col("start_logit") + F.col("end_logit")
    weight = F.exp(total - F.max(total).over(Window.partitionBy("id")))
    listed = listed.withColumn("probability", weight / F.sum(weight).over(Window.partitionBy("id"))).withColumn("rank", F.row_number().over(place))
    best = listed.where("text <> ''").groupBy("id").agg(F.min_by(F.struct("text", total.alias("total")), "rank").alias("_best"))
    scores = best.join(null, "id").select("id", "_best.text", F.col("_null.score").alias("score_null"), (F.col("_null.score") - F.col("_best.total")).alias("score_diff"))
    if with_null:
        predicted = scores.select("id", F.when(F.col("score_diff") > threshold, "").otherwise(F.col("text")).alias("prediction"), "score_null", "score_diff")
    else:
        predicted = scores.select("id", F.col("text").alias("prediction"), "score_null", "score_diff")
    return listed.select("id", "rank", "text", "probability", "start_logit", "end_logit"), predicted


def select_spans(rows: DataFrame, start_logits: Column, end_logits: Column, allowed: Column, top: int, longest: int) -> DataFrame:
    """rows with null_score and a row for each span: start, end, score. Softmax over allowed tokens, the product for token 0 as the score of no
    answer, then the `top` best spans without token 0, of which those that begin and end in allowed tokens stay."""

    def exponentials(logits: Column) -> Column:
        masked = F.transform(logits, lambda x, i: F.when(F.get(allowed, i), x).otherwise(F.lit(-10000.0)))
        return F.transform(F.arrays_zip(masked.alias("x"), F.array_repeat(F.array_max(masked), F.size(logits)).alias("m")), lambda z: F.exp(z["x"] - z["m"]))

    # Stored step by step: an array that a lambda looks into is made anew for each of its elements unless it is a column of a table.
    made = stored(rows.select(*rows.columns, exponentials(start_logits).alias("_s"), exponentials(end_logits).alias("_e"), allowed.alias("_ok")), "exponentials")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    scale = 1 / (total("_s") * total("_e"))
    without = lambda c: F.concat(F.array(F.lit(0.0)), F.slice(c, 2, F.size(c)))
    made = stored(made.select(*rows.columns, "_ok", without("_s").alias("_s"), without("_e").alias("_e"), scale.alias("_scale"), (F.get("_s", F.lit(0)) * F.get("_e", F.lit(0)) * scale).alias("null_score")), "probabilities")
    best = F.filter(span_candidates(F.col("_s"), F.col("_e"), longest, top), lambda x: F.get("_ok", x["start"]) & F.get("_ok", x["end"]))
    spans = made.select(*rows.columns, "null_score", "_scale", F.explode(best).alias("_x"))
    return spans.select(*rows.columns, "null_score", "_x.start", "_x.end", (F.col("_x.score") * F.col("_scale")).alias("score"))
