"""Metrics as grouped aggregates. Every function returns one row (or one a group); empty input gives nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer_tokens, exact_match, f1_of_tokens, token_f1_with_empty

ROUND = 6


def answer_scores(pairs: DataFrame, prediction: str = "prediction", gold: str = "gold") -> DataFrame:
    """pairs with em, f1, precision, recall."""
    split = pairs.withColumn("_p", answer_tokens(F.col(prediction))).withColumn("_g", answer_tokens(F.col(gold)))
    f = split.withColumn("_f", f1_of_tokens(F.col("_p"), F.col("_g"))).withColumn("em", (F.array_join("_p", " ") == F.array_join("_g", " ")).cast("int"))
    return f.select(*pairs.columns, "em", F.col("_f.f1").alias("f1"), F.col("_f.precision").alias("precision"), F.col("_f.recall").alias("recall"))


def mean_scores(pairs: DataFrame, prediction: str = "prediction", gold: str = "gold") -> DataFrame:
    scored = answer_scores(pairs, prediction, gold)
    return scored.agg(F.count("*").alias("n"), *[F.round(F.avg(c), ROUND).alias(c) for c in ("em", "f1", "precision", "recall")])


def best_over_golds(rows: DataFrame, key: str, prediction: str, golds: str) -> DataFrame:
    """key, em, f1: the best over an item's answers; an item without answers has the empty one, an item without a prediction is left out."""
    one = rows.where(F.col(prediction).isNotNull()).select(key, F.col(prediction).alias("_p"), F.explode(F.when(F.size(golds) > 0, F.col(golds)).otherwise(F.array(F.lit("")))).alias("_g"))
    return one.groupBy(key).agg(F.max(exact_match(F.col("_p"), F.col("_g"))).alias("em"), F.round(F.max(token_f1_with_empty(F.col("_p"), F.col("_g"))), ROUND).alias("f1"))


def with_no_answer(score: Column, na_prob: Column, has_answer: Column, threshold: float) -> Column:
    """Above the threshold an item counts as unanswered: right if it has no answer."""
    return F.when(na_prob > threshold, (~has_answer).cast("double")).otherwise(score)


def split_by_answer(rows: DataFrame, has_answer: str, *scores: str) -> DataFrame:
    """Means times 100 over all rows and over those with and without answer."""
    part = lambda name, cond: [F.round(100 * F.avg(F.when(cond, F.col(s))), ROUND).alias(f"{name}{s}") for s in scores] + [F.sum(F.when(cond, 1).otherwise(0)).cast("long").alias(f"{name}total")]
    has = F.col(has_answer)
    return rows.agg(*part("", F.lit(True)), *part("has_answer_", has), *part("no_answer_", ~has))


def best_threshold(rows: DataFrame, key: str, score: str, na_prob: str, has_answer: str, empty: str) -> DataFrame:
    """best (percent), threshold, has_answer_mean: the no-answer threshold with the first strictly greatest total.

    Items in order of na_prob and key add their score, or -1 where they have no answer but a prediction; the total starts
    at the number of items without answer. Running sums go by blocks of numbered items, so no window spans the rows of the
    table, nor those of a threshold that many share.
    """
    from .order import with_row_number

    gain = F.when(F.col(has_answer), F.col(score)).otherwise(F.when(F.col(empty), 0.0).otherwise(-1.0))
    base = rows.select(F.col(na_prob).alias("na"), F.col(key).alias("k"), gain.alias("g"), F.col(has_answer).alias("h"), F.col(score).alias("s"))
    base = with_row_number(base, "na", "k", name="row").withColumn("block", F.floor(F.col("row") / 8192))
    sums = base.groupBy("block").agg(F.sum("g").alias("sum"))
    before = sums.select("block", F.coalesce(F.sum("sum").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))  # a row for each block
    start = base.agg(F.sum(F.when(~F.col("h"), 1.0).otherwise(0.0)).alias("start"), F.count("*").alias("n"), F.sum(F.when(F.col("h"), 1).otherwise(0)).alias("n_has"), F.sum(F.when(F.col("h"), F.col("s"))).alias("has_sum"))
    within = F.sum("g").over(Window.partitionBy("block").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = base.withColumn("within", within).join(before, "block").crossJoin(F.broadcast(start)).withColumn("total", F.round(F.col("start") + F.col("before") + F.col("within"), ROUND))
    best = swept.agg(F.min(F.struct((-F.col("total")).alias("t"), "na", "k")).alias("b"), F.first("start").alias("start"), F.first("n").alias("n"), F.first("n_has").alias("n_has"), F.first("has_sum").alias("has_sum"))
    none = (-F.col("b.t")) <= F.col("start")
    has = F.round(F.col("has_sum") / F.col("n_has"), ROUND)
    return best.select(F.round(100.0 * F.greatest(-F.col("b.t"), F.col("start")) / F.col("n"), ROUND).alias("best"), F.when(none, 0.0).otherwise(F.col("b.na")).alias("threshold"), has.alias("has_answer_mean"))


def confusion(rows: DataFrame, prediction: str, label: str) -> DataFrame:
    p, y = F.col(prediction), F.col(label)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.agg(count((p == 1) & (y == 1)).alias("tp"), count((p == 1) & (y == 0)).alias("fp"), count((p == 0) & (y == 1)).alias("fn"), count((p == 0) & (y == 0)).alias("tn"))


def accuracy_and_f1(rows: DataFrame, prediction: str, label: str) -> DataFrame:
    c = confusion(rows, prediction, label)
    acc = (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return c.select(F.round(acc, ROUND).alias("acc"), F.round(f1, ROUND).alias("f1"), F.round((acc + f1) / 2, ROUND).alias("acc_and_f1"))


def matthews(rows: DataFrame, prediction: str, label: str) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    below = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return confusion(rows, prediction, label).select(F.round(F.when(below == 0, 0.0).otherwise((tp * tn - fp * fn) / below), ROUND).alias("mcc"))


def average_rank(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Average ranks by way of counts of distinct values, which are dealt out by range."""
    from .order import with_row_number

    counts = rows.groupBy(value).agg(F.count("*").alias("_n"))
    numbered = with_row_number(counts, value, name="_row")
    parts = numbered.withColumn("_block", F.floor(F.col("_row") / 1024))
    sums = parts.groupBy("_block").agg(F.sum("_n").alias("_sum"))
    before = sums.select("_block", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum("_n").over(Window.partitionBy("_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1))
    ranked = parts.withColumn("_within", F.coalesce(within, F.lit(0))).join(F.broadcast(before), "_block").select(value, (F.col("_before") + F.col("_within") + (F.col("_n") + 1) / 2).alias(name))
    return rows.join(ranked, value)


def pearson_and_spearman(rows: DataFrame, prediction: str, label: str) -> DataFrame:
    ranked = average_rank(average_rank(rows, prediction, "_rp"), label, "_rl")
    both = ranked.agg(F.corr(F.col(prediction).cast("double"), F.col(label).cast("double")).alias("p"), F.corr("_rp", "_rl").alias("s"))
    return both.select(F.round("p", ROUND).alias("pearson"), F.round("s", ROUND).alias("spearman"), F.round((F.col("p") + F.col("s")) / 2, ROUND).alias("corr"))


#: Task to metric set and to output mode, as benchmark suites name them.
TASK_METRICS = {"cola": "mcc", "sst-2": "acc", "mrpc": "acc_and_f1", "sts-b": "corr", "qqp": "acc_and_f1", "mnli": "acc", "mnli-mm": "acc", "qnli": "acc", "rte": "acc", "wnli": "acc", "hans": "acc", "xnli": "acc"}
TASK_OUTPUT = {task: "regression" if task == "sts-b" else "classification" for task in TASK_METRICS}
TASK_LABELS = {"cola": 2, "mnli": 3, "mrpc": 2, "sst-2": 2, "sts-b": 1, "qqp": 2, "qnli": 2, "rte": 2, "wnli": 2}


def task_metrics(task: str, rows: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """The metrics of a named task; an unknown name is a KeyError."""
    kind = TASK_METRICS[task]
    if kind == "mcc":
        return matthews(rows, prediction, label)
    if kind == "corr":
        return pearson_and_spearman(rows, prediction, label)
    if kind == "acc_and_f1":
        return accuracy_and_f1(rows, prediction, label)
    return rows.agg(F.round(F.avg((F.col(prediction) == F.col(label)).cast("double")), ROUND).alias("acc"))


def cross_entropy(rows: DataFrame, group: str, score: str, is_target: str) -> DataFrame:
    """group, loss: -log softmax of the target's score among its group's."""
    most = rows.groupBy(group).agg(F.max(score).alias("_m"), F.max(F.when(F.col(is_target), F.col(score))).alias("_t"))
    return rows.join(most, group).groupBy(group, "_m", "_t").agg(F.log(F.sum(F.exp(F.col(score) - F.col("_m")))).alias("_l")).select(group, F.round(F.col("_l") + F.col("_m") - F.col("_t"), ROUND).alias("loss"))


def perplexity(rows: DataFrame, loss: str) -> DataFrame:
    return rows.agg(F.round(F.exp(F.avg(loss)), ROUND).alias("perplexity"))


def speed(samples: Column, seconds: Column, steps: Column | None = None) -> Column:
    """Struct runtime, samples_per_second and, with steps, steps_per_second; no time gives null rates."""
    out = [F.round(seconds, 4).alias("runtime"), F.round(F.try_divide(samples, seconds), 3).alias("samples_per_second")]
    return F.struct(*out, *([F.round(F.try_divide(steps, seconds), 3).alias("steps_per_second")] if steps is not None else []))


def objective(metrics: Column, speed_keys: tuple[str, ...] = ("_runtime", "_per_second")) -> Column:
    """Sum of a map's metrics without loss, epoch and speeds; the loss where nothing else is left."""
    kept = F.map_filter(metrics, lambda k, _: ~(k.isin("eval_loss", "epoch") | F.lit(False) | k.endswith(speed_keys[0]) | k.endswith(speed_keys[1])))
    return F.when(F.size(F.map_keys(kept)) == 0, metrics["eval_loss"]).otherwise(F.aggregate(F.map_values(kept), F.lit(0.0), lambda s, x: s + x))


def clock_seconds(text: Column) -> Column:
    """h:m:s, m:s or seconds as seconds."""
    parts = F.transform(F.split(text, ":"), lambda x: x.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s * 60 + x)


def relative_runs(runs: DataFrame, variation: str, value: str, base: str | None = None) -> DataFrame:
    """variation, mean, diff_percent: means of repeated runs and their difference to a named variation, or to the least."""
    means = runs.groupBy(variation).agg(F.avg(value).alias("mean"))
    own = means.where(F.col(variation) == base) if base is not None else means
    ref = own.agg(F.min("mean").alias("_base"))
    return means.crossJoin(F.broadcast(ref)).select(variation, F.round("mean", ROUND).alias("mean"), F.bround(100 * (F.col("mean") - F.col("_base")) / F.col("_base")).cast("long").alias("diff_percent"))


def counted_details(rows: DataFrame, key: str, *details: str) -> DataFrame:
    """key, n, details (sorted): count and rows of each key."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(*details))).alias("details"))


def two_level_counts(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """outer, total, top (most frequent inner key), top_n, and a map of counts, outer keys without any left out."""
    fine = rows.where(F.col(outer).isNotNull() & F.col(inner).isNotNull()).groupBy(outer, inner).agg(F.count("*").alias("n"))
    top = F.min(F.struct((-F.col("n")).alias("m"), F.col(inner).alias("i")))
    return fine.groupBy(outer).agg(F.sum("n").alias("total"), top.alias("t"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(inner, "n")))).alias("counts")).select(outer, "total", F.col("t.i").alias("top"), (-F.col("t.m")).alias("top_n"), "counts")


def word_error_rate(reference: Column, prediction: Column) -> Column:
    """Word edit distance over reference words, through a code letter for each distinct word (65,000 at most)."""
    from ..functions.text import once, tokens

    coded = lambda a, names: F.array_join(F.transform(a, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(names, w) + 256), 4, "0")), "UTF-16BE")), "")
    rate = lambda r, p, names: F.levenshtein(coded(r, names), coded(p, names)) / F.size(r)
    pair = F.struct(tokens(reference).alias("r"), tokens(prediction).alias("p"))
    return once(pair, lambda x: once(F.array_distinct(F.concat(x["r"], x["p"])), lambda names: rate(x["r"], x["p"], names)))
