"""Islands, overlaps, spans, blocks and strides over ordered rows and arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def islands(rows: DataFrame, keys: list[str], order: str, breaks: Column, name: str = "island") -> DataFrame:
    """Numbers of runs within keys: a row where `breaks` holds begins a new one."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn(name, F.sum(breaks.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def entity_groups(tagged: DataFrame, keys: list[str], order: str, tag: str, word: str, score: str) -> DataFrame:
    """Adjacent rows of one entity type merged, unless a tag begins with B-. Words joined, score averaged."""
    kind = F.regexp_replace(F.col(tag), "^[BI]-", "")
    w = Window.partitionBy(*keys).orderBy(order)
    base = tagged.withColumn("_kind", kind)
    new = F.col(tag).startswith("B-") | ~F.lag("_kind").over(w).eqNullSafe(F.col("_kind"))
    grouped = islands(base.withColumn("_new", new), keys, order, F.col("_new"), "_island")
    return grouped.groupBy(*keys, "_island", "_kind").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.round(F.avg(score), 6).alias("score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, word))), lambda x: x[word]), " ").alias("words")).select(*keys, F.col("_kind").alias("entity"), "start", "end", "score", "words")


def word_groups(pieces: DataFrame, keys: list[str], order: str, piece: str, tag: str, score: str, strategy: str = "first") -> DataFrame:
    """Runs of word pieces (## continues a word) as words, with the tag of the first piece, of the best, or of the best average."""
    grouped = islands(pieces, keys, order, ~F.col(piece).startswith("##"), "_word")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, piece))), lambda x: F.regexp_replace(x[piece], "^##", "")), "")
    if strategy == "average":
        fine = grouped.groupBy(*keys, "_word", tag).agg(F.sum(score).alias("_s"))
        size = grouped.groupBy(*keys, "_word").agg(F.count("*").alias("_n"), whole.alias("word"))
        best = fine.groupBy(*keys, "_word").agg(F.min(F.struct((-F.col("_s")).alias("s"), F.col(tag).alias("t"))).alias("b"))
        return best.join(size, [*keys, "_word"]).select(*keys, F.col("_word").alias("word_no"), "word", F.col("b.t").alias("tag"), F.round(-F.col("b.s") / F.col("_n"), 6).alias("score"))
    pick = F.min(F.struct(F.col(order).alias("o"), F.col(tag).alias("t"), F.col(score).alias("s"))) if strategy == "first" else F.min(F.struct((-F.col(score)).alias("o"), F.col(tag).alias("t"), F.col(score).alias("s")))
    return grouped.groupBy(*keys, "_word").agg(whole.alias("word"), pick.alias("b")).select(*keys, F.col("_word").alias("word_no"), "word", F.col("b.t").alias("tag"), F.round("b.s", 6).alias("score"))


def collapse_runs(items: DataFrame, keys: list[str], order: str, item: str, blank: str) -> DataFrame:
    """Equal neighbours merged, blanks removed: item, first and last place of every run left."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = ~F.lag(item).over(w).eqNullSafe(F.col(item))
    grouped = islands(items.withColumn("_new", new), keys, order, F.col("_new"), "_run")
    return grouped.groupBy(*keys, "_run", item).agg(F.min(order).alias("start"), F.max(order).alias("end")).where(F.col(item) != blank).select(*keys, item, "start", "end")


def resolve_overlaps(spans: DataFrame, keys: list[str], start: str, end: str, score: str, label: str) -> DataFrame:
    """Spans in order of start; of two that overlap the longer stays, the better scored where equally long."""
    kind = f"array<struct<s:bigint,e:bigint,score:double,label:string>>"
    ordered = F.array_sort(F.collect_list(F.struct(F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), F.col(score).cast("double").alias("score"), F.col(label).alias("label"))))

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        wider = (x["e"] - x["s"] > last["e"] - last["s"]) | ((x["e"] - x["s"] == last["e"] - last["s"]) & (x["score"] > last["score"]))
        body = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(F.size(kept) == 0, F.array(x)).when(x["s"] >= last["e"], F.concat(kept, F.array(x))).when(wider, F.concat(body, F.array(x))).otherwise(kept)

    folded = spans.groupBy(*keys).agg(F.aggregate(ordered, F.array().cast(kind), step).alias("_kept"))
    return folded.select(*keys, F.explode("_kept").alias("x")).select(*keys, F.col("x.s").alias("start"), F.col("x.e").alias("end"), F.col("x.score").alias("score"), F.col("x.label").alias("label"))


def best_spans(spans: pd.DataFrame, n: int, start: str = "start", end: str = "end", score: str = "score") -> pd.DataFrame:
    """The n best spans of which none contains another; for groupBy(...).applyInPandas."""
    kept: list[int] = []
    rows = spans.sort_values([score, start, end], ascending=[False, True, True]).reset_index(drop=True)
    for i, r in rows.iterrows():
        if len(kept) == n:
            break
        inside = any((rows.at[k, start] <= r[start] <= r[end] <= rows.at[k, end]) or (r[start] <= rows.at[k, start] <= rows.at[k, end] <= r[end]) for k in kept)
        if not inside:
            kept.append(i)
    return rows.loc[kept]


def suppress_overlapping(boxes: pd.DataFrame, threshold: float = 0.3) -> pd.DataFrame:
    """Greedy non-maximum suppression: by score, a box goes when it covers a better one by more than the threshold."""
    rows = boxes.sort_values(["score", "x0", "y0"], ascending=[False, True, True]).reset_index(drop=True)
    area = (rows.x1 - rows.x0) * (rows.y1 - rows.y0)
    alive = [True] * len(rows)
    for i in range(len(rows)):
        if alive[i]:
            w = (rows.x1.clip(upper=rows.x1[i]) - rows.x0.clip(lower=rows.x0[i])).clip(lower=0)
            h = (rows.y1.clip(upper=rows.y1[i]) - rows.y0.clip(lower=rows.y0[i])).clip(lower=0)
            cover = (w * h) / (area + area[i] - w * h)
            for j in range(i + 1, len(rows)):
                if cover[j] > threshold:
                    alive[j] = False
    return rows[alive]


def span_candidates(start_scores: Column, end_scores: Column, longest: int, top: int) -> Column:
    """The `top` best (start, end, score) with start <= end < start + longest, by the product of the two scores."""
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size(start_scores) - 1),
            lambda i: F.transform(F.sequence(i, F.least(i + longest - 1, F.size(end_scores) - 1)), lambda j: F.struct((-(F.element_at(start_scores, i + 1) * F.element_at(end_scores, j + 1))).alias("neg"), i.alias("s"), j.alias("e"))),
        )
    )
    return F.transform(F.slice(F.array_sort(pairs), 1, top), lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"), (-x["neg"]).alias("score")))


def n_best(scores: Column, n: int) -> Column:
    """0-based places of the n greatest values, earlier ones first among equals."""
    placed = F.transform(scores, lambda x, i: F.struct((-x).alias("neg"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(placed), 1, n), lambda x: x["i"])


def fixed_blocks(items: Column, size: int) -> Column:
    """Blocks of `size`, the rest dropped."""
    n = F.floor(F.size(items) / size)
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>")), lambda k: F.slice(items, k * size + 1, size))


def packed_blocks(rows: DataFrame, size: int, batch: str, order: str, words: str) -> DataFrame:
    """batch, block, part: the words of a batch's rows, one row after another in order, in blocks of `size`; only a batch's last,
    shorter block is dropped. A batch has a bounded number of rows."""
    length = F.size(words)
    start = F.sum(length).over(Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - length
    placed = rows.withColumn("_start", start).select(batch, "_start", F.posexplode(words).alias("_i", "_w")).select(batch, (F.col("_start") + F.col("_i")).alias("_at"), "_w")
    blocks = placed.groupBy(batch, F.floor(F.col("_at") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("_at", "_w"))).alias("_part"))
    return blocks.where(F.size("_part") == size).select(batch, "block", F.transform("_part", lambda x: x["_w"]).alias("part"))


def strided_chunks(items: Column, length: int, stride: int) -> Column:
    """Structs start, part: chunks that start every `stride` until one reaches the end."""
    n = F.size(items)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride)), lambda s: (s == 0) | (s - stride + length < n))
    return F.transform(F.when(n > 0, starts).otherwise(F.array().cast("array<int>")), lambda s: F.struct(s.alias("start"), F.slice(items, s + 1, length).alias("part")))


def scoring_windows(n: Column, length: int, stride: int) -> Column:
    """Structs begin, end, scored: windows over n items of which only those not seen before are scored."""
    last = F.greatest(n - 1, F.lit(0))
    begins = F.filter(F.sequence(F.lit(0), last, F.lit(stride)), lambda b: (b == 0) | (b - stride + length < n))
    end = lambda b: F.least(b + length, n)
    return F.transform(F.when(n > 0, begins).otherwise(F.array().cast("array<int>")), lambda b: F.struct(b.alias("begin"), end(b).alias("end"), (end(b) - F.when(b == 0, F.lit(0)).otherwise(end(b - stride))).alias("scored")))


def max_context_chunk(chunks: DataFrame, keys: list[str], start: str, length: str, position: Column) -> DataFrame:
    """keys, position, chunk start: of the chunks that hold a position, the one with most context: min(left, right) + length / 100."""
    s, n = F.col(start), F.col(length)
    inside = chunks.withColumn("_pos", F.explode(position)).where((F.col("_pos") >= s) & (F.col("_pos") < s + n))
    context = F.least(F.col("_pos") - s, s + n - 1 - F.col("_pos")) + 0.01 * n
    return inside.groupBy(*keys, "_pos").agg(F.min(F.struct((-context).alias("c"), s.alias("s"))).alias("b")).select(*keys, F.col("_pos").alias("position"), F.col("b.s").alias("chunk_start"))


def byte_chunks(data: Column, length: int, left: int, right: int) -> Column:
    """Structs start, n, left, right: chunks of `length` bytes that overlap; the last only if longer than the left stride."""
    step, n = length - left - right, F.length(data)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0)), F.lit(step)), lambda s: (s + length <= n) | ((n - s > left) & ((s == 0) | (s - step + length <= n))))
    size = lambda s: F.least(F.lit(length), n - s)
    return F.transform(starts, lambda s: F.struct(s.alias("start"), size(s).alias("n"), F.when(s == 0, F.lit(0)).otherwise(F.lit(left)).alias("left"), F.when(s + length <= n, F.lit(right)).otherwise(F.lit(0)).alias("right")))


def cumulative_means(batches: list[list[float]], compat: bool = False) -> Iterator[float]:
    """Running mean over batches; with compat the recurrence that divides by the old count."""
    mean, count = 0.0, 0
    for batch in batches:
        n = len(batch)
        if compat and count:
            mean = (mean * (count - n) + sum(batch)) / count
        else:
            mean = (mean * count + sum(batch)) / (count + n)
        count += n
        yield mean


def folded(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[object, dict], tuple[object, tuple]], start: object, schema: str) -> DataFrame:
    """An ordered fold in which each row sees what the row before it left: step(state, row) gives the next state and an output row, of `schema`.

    Rows go to the partition of their key and are sorted there; a task walks through them batch by batch and holds one state, so that a key
    with very many rows takes time but no memory. Sorting spills as any other sort does.
    """
    fields = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, start
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                mine = tuple(row[k] for k in keys)
                if key != (mine,):
                    key, state = (mine,), start
                state, made = step(state, row)
                out.append(made)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(fields)], schema=fields)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(walk, schema)
