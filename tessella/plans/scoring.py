"""Evaluation queries. Predictions and references are an assistant's turn and the turn before it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from .registry import query, table

_NORM = "list_filter(string_split_regex(regexp_replace(lower(coalesce({0}, '')), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"
_PAIRS = """prs AS (SELECT conv_id, turn, text AS prediction, prev AS gold FROM (
  SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prole FROM conversations) WHERE role = 'assistant' AND prole = 'user')"""
_TOK = f"tok AS (SELECT conv_id, turn, {_NORM.format('prediction')} AS p, {_NORM.format('gold')} AS g FROM prs)"
_OVER = """ov AS (SELECT conv_id, turn, p, g, coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))), 0) AS c FROM tok)"""
_NONE = "(c = 0 OR (p <> g AND (array_to_string(p, ' ') IN ('yes', 'no', 'noanswer') OR array_to_string(g, ' ') IN ('yes', 'no', 'noanswer'))))"
_F1 = f"f AS (SELECT conv_id, turn, CASE WHEN p = g THEN 1 ELSE 0 END AS em, CASE WHEN {_NONE} THEN 0.0 ELSE 2.0 * c / (len(p) + len(g)) END AS f1, CASE WHEN {_NONE} THEN 0.0 ELSE c / len(p) END AS precision, CASE WHEN {_NONE} THEN 0.0 ELSE c / len(g) END AS recall FROM ov)"
_WITH = f"WITH {_PAIRS}, {_TOK}, {_OVER}, {_F1}"


def pairs(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("gold", F.lag("text").over(w)).withColumn("prole", F.lag("role").over(w))
    return c.where("role = 'assistant' AND prole = 'user'").select("conv_id", "turn", F.col("text").alias("prediction"), "gold")


def scores(spark, d):
    """Rows with a no-answer probability, score and flags made from labels: a stand-in for a question answering run."""
    l = table(spark, d, "labels")
    return l.select("doc_id", (F.pmod(F.col("doc_id") * 37, F.lit(101)) / 101.0).alias("na_prob"), (F.pmod(F.col("doc_id") * 17, F.lit(11)) / 10.0).alias("score"), (F.col("quality") == 1).alias("has_answer"), (F.col("toxic") == 1).alias("empty"))


_SCORES = "s AS (SELECT doc_id, (doc_id * 37 % 101) / 101.0 AS na_prob, (doc_id * 17 % 11) / 10.0 AS score, quality = 1 AS has_answer, toxic = 1 AS empty FROM labels)"


@query("normalize_answer", f"SELECT doc_id, array_to_string({_NORM.format('text')}, ' ') AS normalized FROM documents")
def normalize_answer(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_answer(F.col("text")).alias("normalized"))


@query("exact_match", f"{_WITH} SELECT conv_id, turn, em FROM f")
def exact_match(spark, d):
    return pairs(spark, d).select("conv_id", "turn", T.exact_match(F.col("prediction"), F.col("gold")).alias("em"))


@query("token_f1", f"{_WITH} SELECT conv_id, turn, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM f")
def token_f1(spark, d):
    s = E.answer_scores(pairs(spark, d))
    return s.select("conv_id", "turn", *[F.round(c, 6).alias(c) for c in ("f1", "precision", "recall")])


@query("token_f1_with_empty", f"{_WITH} SELECT conv_id, turn, round(CASE WHEN len(p) = 0 OR len(g) = 0 THEN CASE WHEN len(p) = len(g) THEN 1.0 ELSE 0.0 END WHEN c = 0 THEN 0.0 ELSE 2.0 * c / (len(p) + len(g)) END, 6) AS f1 FROM ov")
def token_f1_with_empty(spark, d):
    return pairs(spark, d).select("conv_id", "turn", F.round(T.token_f1_with_empty(F.col("prediction"), F.col("gold")), 6).alias("f1"))


@query("eval_mean", f"{_WITH} SELECT count(*) AS n, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall FROM f")
def eval_mean(spark, d):
    return E.mean_scores(pairs(spark, d))


@query("best_over_golds", f"""WITH u AS (SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS prediction, list(text) FILTER (WHERE role = 'user') AS golds FROM conversations GROUP BY 1),
prs AS (SELECT conv_id, i AS turn, prediction, golds[i] AS gold FROM (SELECT *, unnest(range(1, len(golds) + 1)) AS i FROM u WHERE prediction IS NOT NULL)),
{_TOK}, {_OVER} SELECT conv_id, max(CASE WHEN p = g THEN 1 ELSE 0 END) AS em, round(max(CASE WHEN len(p) = 0 OR len(g) = 0 THEN CASE WHEN len(p) = len(g) THEN 1.0 ELSE 0.0 END WHEN c = 0 THEN 0.0 ELSE 2.0 * c / (len(p) + len(g)) END), 6) AS f1 FROM ov GROUP BY 1""")
def best_over_golds(spark, d):
    c = table(spark, d, "conversations")
    one = c.groupBy("conv_id").agg(F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("_t"), F.max(F.when(F.col("role") == "assistant", F.struct("turn", "text"))).alias("a"), F.collect_list(F.when(F.col("role") == "user", F.col("text"))).alias("golds"))
    return E.best_over_golds(one.select("conv_id", F.col("a.text").alias("prediction"), "golds"), "conv_id", "prediction", "golds")


@query("no_answer_threshold", f"WITH {_SCORES} SELECT doc_id, CAST(CASE WHEN na_prob > 0.5 THEN CASE WHEN has_answer THEN 0.0 ELSE 1.0 END ELSE score END AS DOUBLE) AS score FROM s")
def no_answer_threshold(spark, d):
    return scores(spark, d).select("doc_id", E.with_no_answer(F.col("score"), F.col("na_prob"), F.col("has_answer"), 0.5).alias("score"))


@query("has_no_answer_split", f"WITH {_SCORES} SELECT round(100 * avg(score), 6) AS score, count(*) AS total, round(100 * avg(score) FILTER (WHERE has_answer), 6) AS has_answer_score, count(*) FILTER (WHERE has_answer) AS has_answer_total, round(100 * avg(score) FILTER (WHERE NOT has_answer), 6) AS no_answer_score, count(*) FILTER (WHERE NOT has_answer) AS no_answer_total FROM s")
def has_no_answer_split(spark, d):
    return E.split_by_answer(scores(spark, d), "has_answer", "score")


@query("best_threshold", f"""WITH {_SCORES}, st AS (SELECT count(*) FILTER (WHERE NOT has_answer) AS z, count(*) AS n FROM s),
r AS (SELECT na_prob, doc_id, round(z + sum(CASE WHEN has_answer THEN score WHEN empty THEN 0 ELSE -1 END) OVER (ORDER BY na_prob, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS t FROM s, st),
b AS (SELECT na_prob, t FROM r ORDER BY t DESC, na_prob, doc_id LIMIT 1)
SELECT round(100.0 * greatest(t, z) / n, 6) AS best, CASE WHEN t <= z THEN 0.0 ELSE na_prob END AS threshold, (SELECT round(avg(score), 6) FROM s WHERE has_answer) AS has_answer_mean FROM b, st""")
def best_threshold(spark, d):
    return E.best_threshold(scores(spark, d), "doc_id", "score", "na_prob", "has_answer", "empty")


@query("accuracy_f1", "WITH c AS (SELECT avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0 END) AS a, 2.0 * count(*) FILTER (WHERE quality = 1 AND toxic = 1) / (2.0 * count(*) FILTER (WHERE quality = 1 AND toxic = 1) + count(*) FILTER (WHERE quality <> toxic)) AS f FROM labels) SELECT round(a, 6) AS acc, round(f, 6) AS f1, round((a + f) / 2, 6) AS acc_and_f1 FROM c")
def accuracy_f1(spark, d):
    return E.task_metrics("mrpc", table(spark, d, "labels"), "quality", "toxic")


@query("matthews", "WITH c AS (SELECT CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS DOUBLE) AS tn FROM labels) SELECT round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c")
def matthews(spark, d):
    return E.task_metrics("cola", table(spark, d, "labels"), "quality", "toxic")


@query("pearson_spearman", """WITH r AS (SELECT *, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(corr(a, b), 6) AS spearman, round((corr(l_quantity, l_extendedprice) + corr(a, b)) / 2, 6) AS corr FROM r""")
def pearson_spearman(spark, d):
    return E.task_metrics("sts-b", table(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice")


@query("cross_entropy", "WITH c AS (SELECT event_type, user_id, value / 50 AS s FROM events), t AS (SELECT event_type, user_id, max(s) AS target FROM c GROUP BY ALL) SELECT user_id, round(ln(sum(exp(s))) - max(s), 6) AS loss FROM c GROUP BY 1")
def cross_entropy(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("value") / 50).alias("s"))
    best = e.groupBy("user_id").agg(F.max("s").alias("top"))
    return E.cross_entropy(e.join(best, "user_id").withColumn("is_target", F.col("s") == F.col("top")), "user_id", "s", "is_target")


@query("pairwise_accuracy", "SELECT round(avg(CASE WHEN l_discount >= l_tax THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM lineitem")
def pairwise_accuracy(spark, d):
    return table(spark, d, "lineitem").agg(F.round(F.avg((F.col("l_discount") >= F.col("l_tax")).cast("double")), 6).alias("accuracy"))


@query("perplexity", "SELECT round(exp(avg(l_tax * 10)), 6) AS perplexity FROM lineitem")
def perplexity(spark, d):
    return E.perplexity(table(spark, d, "lineitem").select((F.col("l_tax") * 10).alias("loss")), "loss")


@query("speed_metrics", "SELECT user_id, round(sum(value), 4) AS runtime, round(CASE WHEN sum(value) = 0 THEN NULL ELSE count(*) / sum(value) END, 3) AS samples_per_second FROM events GROUP BY 1")
def speed_metrics(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("t"))
    return g.select("user_id", E.speed(F.col("n"), F.col("t")).alias("s")).select("user_id", "s.*")


@query("objective_sum", "SELECT o_orderkey, o_totalprice + o_custkey AS objective FROM orders")
def objective_sum(spark, d):
    m = F.create_map(F.lit("eval_loss"), F.lit(1.0), F.lit("epoch"), F.lit(3.0), F.lit("eval_runtime"), F.lit(9.0), F.lit("eval_price"), F.col("o_totalprice"), F.lit("eval_cust"), F.col("o_custkey").cast("double"))
    return table(spark, d, "orders").select("o_orderkey", E.objective(m).alias("objective"))


@query("clock_total", "SELECT user_id, CAST(sum(hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT)) AS DOUBLE) AS seconds FROM events GROUP BY 1")
def clock_total(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.sum(E.clock_seconds(F.date_format("ts", "H:m:s"))).alias("seconds"))


@query("relative_runs", "WITH m AS (SELECT event_type, avg(value) AS mean FROM events GROUP BY 1) SELECT event_type, round(mean, 6) AS mean, CAST(round_even(100 * (mean - b) / b, 0) AS BIGINT) AS diff_percent FROM m, (SELECT min(mean) AS b FROM m)")
def relative_runs(spark, d):
    return E.relative_runs(table(spark, d, "events"), "event_type", "value")


@query("error_counts", "SELECT l_returnflag || l_linestatus AS error, count(*) AS n, max(l_orderkey) AS last FROM lineitem GROUP BY 1")
def error_counts(spark, d):
    return table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("error")).agg(F.count("*").alias("n"), F.max("l_orderkey").alias("last"))


@query("error_details", "SELECT o_custkey, count(*) AS n, list(o_orderkey || ':' || o_orderstatus ORDER BY o_orderkey) AS details FROM orders GROUP BY 1")
def error_details(spark, d):
    rows = E.counted_details(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderstatus")
    return rows.withColumn("details", F.transform("details", lambda x: F.concat_ws(":", x["o_orderkey"], x["o_orderstatus"])))


@query("model_error_top", """WITH f AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, CAST(sum(n) AS BIGINT) AS total, arg_min(event_type, (-n, event_type)) AS top, max(n) AS top_n FROM f GROUP BY 1""")
def model_error_top(spark, d):
    return E.two_level_counts(table(spark, d, "events"), "user_id", "event_type").drop("counts")


@query("checkpoint_latest", "SELECT o_custkey, max(o_orderkey) AS step FROM orders GROUP BY 1")
def checkpoint_latest(spark, d):
    """The greatest number in names checkpoint-N of each folder."""
    names = table(spark, d, "orders").select("o_custkey", F.concat(F.lit("checkpoint-"), "o_orderkey").alias("name"))
    return names.select("o_custkey", F.regexp_extract("name", r"^checkpoint-(\d+)$", 1).cast("long").alias("n")).groupBy("o_custkey").agg(F.max("n").alias("step"))


@query("word_error_rate")
def word_error_rate(spark, d):
    return pairs(spark, d).select("conv_id", "turn", F.round(E.word_error_rate(F.col("gold"), F.col("prediction")), 6).alias("wer"))
