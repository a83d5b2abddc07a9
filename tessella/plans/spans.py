"""Span decoding, entity grouping and run-length queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vector import rounded
from ..operators import sequences as S
from .registry import query, table

_W = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"
_TAG = "CASE WHEN length(w) % 5 = 0 THEN 'B-PER' WHEN length(w) % 5 = 1 THEN 'I-PER' WHEN length(w) % 5 = 2 THEN 'I-LOC' ELSE 'O' END"
_TAGGED = f"tg AS (SELECT item_id, i, ws[i] AS w, (length(ws[i]) % 7) / 7.0 AS score FROM (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT item_id, {_W} AS ws FROM benchmark))), t AS (SELECT *, {_TAG} AS tag FROM tg)"


def tagged(spark, d):
    """Words of benchmark items with a tag and score that their length gives."""
    w = table(spark, d, "benchmark").select("item_id", F.posexplode(T.tokens(F.col("text"))).alias("p", "w"))
    n = F.length("w") % 5
    tag = F.when(n == 0, "B-PER").when(n == 1, "I-PER").when(n == 2, "I-LOC").otherwise("O")
    return w.select("item_id", (F.col("p") + 1).cast("long").alias("i"), "w", ((F.length("w") % 7) / 7.0).alias("score"), tag.alias("tag"))


@query(
    "entity_groups",
    f"""WITH {_TAGGED}, k AS (SELECT *, regexp_replace(tag, '^[BI]-', '') AS kind FROM t),
n AS (SELECT *, CASE WHEN tag LIKE 'B-%' OR lag(kind) OVER (PARTITION BY item_id ORDER BY i) IS DISTINCT FROM kind THEN 1 ELSE 0 END AS new FROM k),
g AS (SELECT *, sum(new) OVER (PARTITION BY item_id ORDER BY i) AS island FROM n)
SELECT item_id, kind AS entity, min(i) AS start, max(i) AS end_, round(avg(score), 6) AS score, string_agg(w, ' ' ORDER BY i) AS words FROM g WHERE kind <> 'O' GROUP BY item_id, island, kind""",
)
def entity_groups(spark, d):
    g = S.entity_groups(tagged(spark, d), ["item_id"], "i", "tag", "w", "score")
    return g.where("entity <> 'O'").withColumnRenamed("end", "end_")


_PIECES = "p AS (SELECT event_id, i, CASE WHEN i = 1 THEN '' ELSE '##' END || x[i] AS piece, CASE WHEN i = 2 THEN 'LOC' ELSE 'PER' END AS tag, i / 4.0 AS score FROM (SELECT event_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT event_id, [event_type[1:2], event_type[3:4], event_type[5:]] AS x FROM events)))"


def pieces(spark, d):
    e = F.col("event_type")
    x = F.array(F.substring(e, 1, 2), F.substring(e, 3, 2), F.substring(e, 5, 99))
    p = table(spark, d, "events").select("event_id", F.posexplode(x).alias("p", "x"))
    i = F.col("p") + 1
    return p.select("event_id", i.cast("long").alias("i"), F.concat(F.when(i == 1, "").otherwise("##"), "x").alias("piece"), F.when(i == 2, "LOC").otherwise("PER").alias("tag"), (i / 4.0).alias("score"))


for _s, _pick in (("first", "arg_min(tag, i)"), ("max", "arg_max(tag, score)"), ("average", "'PER'")):
    _score = {"first": "min(score)", "max": "max(score)", "average": "sum(score) FILTER (WHERE tag = 'PER') / count(*)"}[_s]

    @query(f"word_groups_{_s}", f"WITH {_PIECES} SELECT event_id, string_agg(replace(piece, '##', ''), '' ORDER BY i) AS word, {_pick} AS tag, round({_score}, 6) AS score FROM p GROUP BY 1")
    def _words(spark, d, strategy=_s):
        return S.word_groups(pieces(spark, d), ["event_id"], "i", "piece", "tag", "score", strategy).drop("word_no")


@query("overlap_resolve")
def overlap_resolve(spark, d):
    spans = tagged(spark, d).where("tag <> 'O'").select("item_id", F.col("i").alias("s"), (F.col("i") + F.length("w") % 4 + 1).alias("e"), "score", "tag")
    return S.resolve_overlaps(spans, ["item_id"], "s", "e", "score", "tag").withColumnRenamed("end", "end_")


@query(
    "ctc_collapse",
    """WITH c AS (SELECT item_id, i, x[i] AS c FROM (SELECT item_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT item_id, string_split(text, '') AS x FROM benchmark))),
n AS (SELECT *, CASE WHEN lag(c) OVER (PARTITION BY item_id ORDER BY i) IS DISTINCT FROM c THEN 1 ELSE 0 END AS new FROM c),
g AS (SELECT *, sum(new) OVER (PARTITION BY item_id ORDER BY i) AS run FROM n)
SELECT item_id, c AS item, min(i) AS start, max(i) AS end_ FROM g WHERE c <> ' ' GROUP BY item_id, run, c""",
)
def ctc_collapse(spark, d):
    c = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "")).alias("p", "item")).select("item_id", (F.col("p") + 1).cast("long").alias("i"), "item")
    return S.collapse_runs(c, ["item_id"], "i", "item", " ").withColumnRenamed("end", "end_")


@query(
    "word_offsets",
    """WITH c AS (SELECT item_id, i, x[i] AS c FROM (SELECT item_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT item_id, string_split(text, '') AS x FROM benchmark))),
g AS (SELECT *, sum(CASE WHEN c IN (' ', chr(10)) THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY i) AS k FROM c)
SELECT item_id, string_agg(c, '' ORDER BY i) AS word, min(i) - 1 AS start, max(i) AS end_ FROM g WHERE c NOT IN (' ', chr(10)) GROUP BY item_id, k""",
)
def word_offsets(spark, d):
    """Words and their character offsets by islands between delimiters."""
    c = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "")).alias("p", "c")).select("item_id", F.col("p").cast("long").alias("i"), "c")
    g = S.islands(c, ["item_id"], "i", F.col("c").isin(" ", "\n"), "k").where(~F.col("c").isin(" ", "\n"))
    word = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]), "")
    return g.groupBy("item_id", "k").agg(word.alias("word"), F.min("i").alias("start"), (F.max("i") + 1).alias("end_")).drop("k")


_HALF = "CAST(embedding[1:16] AS DOUBLE[]) AS s, CAST(embedding[17:32] AS DOUBLE[]) AS e"


@query("span_decode", f"SELECT vec_id, start, end_, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, start, end_) AS r FROM (SELECT vec_id, i AS start, j AS end_, s[i + 1] * e[j + 1] AS score FROM (SELECT vec_id, s, e, i, unnest(range(i, least(i + 4, 16))) AS j FROM (SELECT vec_id, s, e, unnest(range(0, 16)) AS i FROM (SELECT vec_id, {_HALF} FROM embeddings))))) WHERE r <= 5")
def span_decode(spark, d):
    half = lambda a: F.slice("embedding", a, 16).cast("array<double>")
    x = table(spark, d, "embeddings").select("vec_id", F.explode(S.span_candidates(half(1), half(17), 4, 5)).alias("x"))
    return x.select("vec_id", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end_"), rounded("x.score", 6).alias("score"))


@query("n_best", "SELECT vec_id, (list_transform(list_sort(list_transform(range(1, 65), lambda i: {'v': -CAST(embedding[i] AS DOUBLE), 'i': i - 1})), lambda x: x.i))[1:5] AS best FROM embeddings")
def n_best(spark, d):
    return table(spark, d, "embeddings").select("vec_id", S.n_best(F.col("embedding").cast("array<double>"), 5).cast("array<bigint>").alias("best"))


@query("best_spans_without_nesting")
def best_spans_without_nesting(spark, d):
    half = lambda a: F.slice("embedding", a, 16).cast("array<double>")
    x = table(spark, d, "embeddings").select("vec_id", F.explode(S.span_candidates(half(1), half(17), 4, 64)).alias("x")).select("vec_id", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"), F.col("x.score").alias("score"))

    def best(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return S.best_spans(pdf, 3)

    return x.groupBy("vec_id").applyInPandas(best, "vec_id long, start long, end long, score double")


@query("span_dedup", f"SELECT item_id, word, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, i) AS INT) AS rank FROM (SELECT item_id, w AS word, round(score, 6) AS score, i, row_number() OVER (PARTITION BY item_id, w ORDER BY score DESC, i) AS r FROM t) WHERE r = 1".replace("SELECT item_id, word", f"WITH {_TAGGED} SELECT item_id, word", 1))
def span_dedup(spark, d):
    """n-best with repeats of a text dropped, the best kept."""
    from pyspark.sql import Window

    t = tagged(spark, d).withColumn("score", F.round("score", 6))
    first = t.withColumn("r", F.row_number().over(Window.partitionBy("item_id", "w").orderBy(F.col("score").desc(), "i"))).where("r = 1")
    return first.select("item_id", F.col("w").alias("word"), "score", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "i")).alias("rank"))


@query("suppress_boxes")
def suppress_boxes(spark, d):
    """Greedy non-maximum suppression per brand, over boxes that part sizes and numbers give."""
    p = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_partkey") % 50).cast("double").alias("x0"), (F.col("p_size") % 50).cast("double").alias("y0"), F.col("p_retailprice").alias("score"))
    boxes = p.withColumn("x1", F.col("x0") + 5).withColumn("y1", F.col("y0") + 5)
    return boxes.groupBy("p_brand").applyInPandas(lambda pdf: S.suppress_overlapping(pdf), boxes.schema)


@query("label_align", f"WITH {_PIECES} SELECT event_id, i, CASE WHEN i = 1 THEN 3 ELSE -100 END AS label FROM p")
def label_align(spark, d):
    """The first piece of a word has its label, the others -100."""
    return pieces(spark, d).select("event_id", "i", F.when(F.col("piece").startswith("##"), -100).otherwise(3).alias("label"))


@query("char_span_to_tokens", f"SELECT item_id, min(k) AS first, max(k) AS last FROM (SELECT item_id, k, sum(length(w) + 1) OVER (PARTITION BY item_id ORDER BY k) - length(w) - 1 AS s, length(w) AS n FROM (SELECT item_id, unnest(range(0, len(ws))) AS k, unnest(ws) AS w FROM (SELECT item_id, {_W} AS ws FROM benchmark))) WHERE s < 30 AND s + n > 10 GROUP BY 1")
def char_span_to_tokens(spark, d):
    """The tokens that characters 10 to 29 of a normalized text touch; none gives (0, 0)."""
    from pyspark.sql import Window

    w = table(spark, d, "benchmark").select("item_id", F.posexplode(T.tokens(F.col("text"))).alias("k", "w"))
    start = F.sum(F.length("w") + 1).over(Window.partitionBy("item_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("w") - 1
    s = w.withColumn("s", start).where((F.col("s") < 30) & (F.col("s") + F.length("w") > 10))
    found = s.groupBy("item_id").agg(F.min("k").cast("long").alias("first"), F.max("k").cast("long").alias("last"))
    return table(spark, d, "benchmark").select("item_id").join(found, "item_id", "left").na.fill(0, ["first", "last"])


@query("masked_softmax", "WITH l AS (SELECT vec_id, unnest(range(0, 64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT vec_id, k, CASE WHEN k % 3 = 1 THEN -10000.0 ELSE x END AS x FROM l), e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM m) SELECT vec_id, CAST(k AS INT) AS k, round(CASE WHEN k = 0 THEN 0 ELSE e / sum(e) OVER (PARTITION BY vec_id) END, 6) AS p, round(first_value(e) OVER (PARTITION BY vec_id ORDER BY k) / sum(e) OVER (PARTITION BY vec_id), 6) AS null_score FROM e")
def masked_softmax(spark, d):
    from ..functions.vector import softmax

    x = F.transform(F.col("embedding").cast("array<double>"), lambda v, i: F.when(i % 3 == 1, -10000.0).otherwise(v))
    p = table(spark, d, "embeddings").select("vec_id", softmax(x).alias("p"))
    return p.select("vec_id", F.round(F.element_at("p", 1), 6).alias("null_score"), F.posexplode("p").alias("k", "v")).select("vec_id", "k", F.round(F.when(F.col("k") == 0, 0.0).otherwise(F.col("v")), 6).alias("p"), "null_score")


@query("cell_means", "SELECT p_brand, p_size, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY ALL HAVING avg(p_retailprice) > 950")
def cell_means(spark, d):
    """Means of a table's cells over their tokens, above a threshold."""
    return table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("m")).where("m > 950").select("p_brand", "p_size", F.round("m", 6).alias("mean"))


@query("regroup_chunks", "SELECT l_orderkey, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1")
def regroup_chunks(spark, d):
    """One row to many chunks and back to one."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    return g.select("l_orderkey", F.explode("q").alias("q")).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("q").alias("quantity"))
