"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vector import rounded
from ..operators import retrieval
from .registry import query, spread, table

_DOT = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))"
_L2 = "list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


#: A search's queries: every vector whose id is divisible by 20, against all vectors.
_ASKED = "q.vec_id % 20 = 0"


def _asked(vectors):
    return vectors.where("vec_id % 20 = 0")


def _top(score: str, k: int, order: str = "DESC", where: str = "true") -> str:
    return f"""SELECT qid, pid, round(s, 6) AS score, CAST(rank AS INT) AS rank FROM (
  SELECT q.vec_id AS qid, c.vec_id AS pid, {score} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {score} {order}, c.vec_id) AS rank
  FROM embeddings q, embeddings c WHERE {where}) WHERE rank <= {k}"""


def _rounded(df):
    return df.withColumn("score", rounded("score", 6))


@query("knn_ip_topk", _top(_DOT, 5, where=_ASKED))
def knn_ip_topk(spark, d):
    v = table(spark, d, "embeddings")
    return _rounded(retrieval.knn(_asked(v), v, 5))


@query("knn_l2_topk", _top(_L2, 5, "ASC", _ASKED))
def knn_l2_topk(spark, d):
    v = table(spark, d, "embeddings")
    return _rounded(retrieval.knn(_asked(v), v, 5, "l2"))


@query("knn_self_join", _top(_DOT, 3))
def knn_self_join(spark, d):
    v = table(spark, d, "embeddings")
    return _rounded(retrieval.knn(v, v, 3))


@query("merge_topk", _top(_DOT, 4, where=_ASKED))
def merge_topk(spark, d):
    """Top-k of each shard, then of all: the same as of the whole."""
    v = table(spark, d, "embeddings")
    q, shard = _asked(v), F.pmod("vec_id", F.lit(3))
    lists = [retrieval.knn(q, v.where(shard == s), 4).select("qid", "pid", "score") for s in range(3)]
    return _rounded(retrieval.merge_top(lists[0].union(lists[1]).union(lists[2]), 4))


@query("hard_negatives", f"SELECT qid, pid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS INT) AS rank FROM ({_top(_DOT, 11)}) WHERE qid <> pid")
def hard_negatives(spark, d):
    return _rounded(retrieval.hard_negatives(table(spark, d, "embeddings").select("vec_id", "embedding"), 11))


@query(
    "label_agreement_at_5",
    f"""SELECT label, count(*) AS n, round(avg(CASE WHEN label = other THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM (
  SELECT q.label, c.label AS other, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, c.vec_id) AS r
  FROM embeddings q, embeddings c WHERE {_ASKED}) WHERE r <= 5 GROUP BY 1""",
)
def label_agreement_at_5(spark, d):
    v = table(spark, d, "embeddings")
    label = v.select(F.col("vec_id").alias("id"), "label")
    hits = retrieval.knn(_asked(v), v, 5).join(label.withColumnRenamed("id", "qid"), "qid").join(label.select(F.col("id").alias("pid"), F.col("label").alias("other")), "pid")
    return hits.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("other")).cast("double")), 6).alias("agreement"))


@query(
    "bm25_top5",
    """WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
tf AS (SELECT doc_id, len(any_value(w)) AS dl, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS term FROM benchmark),
sc AS (SELECT item_id AS qid, doc_id AS pid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.82 / (tf + 0.82 * (1 - 0.68 + 0.68 * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL)
SELECT * FROM (SELECT qid, pid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS INT) AS rank FROM sc) WHERE rank <= 5""",
)
def bm25_top5(spark, d):
    return retrieval.bm25(table(spark, d, "benchmark"), spread(table(spark, d, "documents")), 5)


_HITS = f"hits AS ({_top(_DOT, 50, where=_ASKED)})"


def _hits(spark, d, n=50):
    v = table(spark, d, "embeddings")
    return retrieval.knn(_asked(v), v, n)


@query("attach_neighbors", f"WITH {_HITS} SELECT v.vec_id AS qid, coalesce(list(pid ORDER BY rank) FILTER (WHERE pid IS NOT NULL), []) AS neighbors FROM embeddings v LEFT JOIN (SELECT * FROM hits WHERE rank <= 5) h ON h.qid = v.vec_id GROUP BY 1")
def attach_neighbors(spark, d):
    queries = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"))
    return retrieval.attach_neighbors(queries, _hits(spark, d, 5))


@query("stride_neighbors", f"WITH {_HITS} SELECT qid, list(pid ORDER BY rank) AS neighbors FROM hits WHERE (rank - 1) % 10 = 0 GROUP BY 1")
def stride_neighbors(spark, d):
    from ..functions.vector import stride_slice

    lists = retrieval.attach_neighbors(_asked(table(spark, d, "embeddings")).select(F.col("vec_id").alias("qid")), _hits(spark, d))
    return lists.select("qid", stride_slice(F.col("neighbors"), 10).alias("neighbors"))


@query("gather_text", f"WITH {_HITS} SELECT qid, coalesce(list(text ORDER BY rank) FILTER (WHERE text IS NOT NULL), []) AS texts FROM hits LEFT JOIN documents ON doc_id = pid WHERE rank <= 3 GROUP BY 1")
def gather_text(spark, d):
    lists = retrieval.attach_neighbors(_asked(table(spark, d, "embeddings")).select(F.col("vec_id").alias("qid")), _hits(spark, d, 3))
    return retrieval.gather(lists, table(spark, d, "documents"), "qid", "neighbors", "doc_id", "text", "texts")


@query("gather_vectors", f"WITH {_HITS} SELECT qid, list(embedding ORDER BY rank) AS vectors FROM hits JOIN embeddings ON vec_id = pid WHERE rank <= 2 GROUP BY 1")
def gather_vectors(spark, d):
    v = table(spark, d, "embeddings")
    lists = retrieval.attach_neighbors(_asked(v).select(F.col("vec_id").alias("qid")), _hits(spark, d, 2))
    return retrieval.gather(lists, v, "qid", "neighbors", "vec_id", "embedding", "vectors")


@query("gather_padded", "SELECT vec_id AS qid, list_concat(list_filter([vec_id, vec_id - 3, vec_id - 6], lambda x: x >= 0), list_filter([CAST(-1 AS BIGINT), -1, -1, -1, -1], lambda x, i: i <= 5 - len(list_filter([vec_id, vec_id - 3, vec_id - 6], lambda y: y >= 0)))) AS ids FROM embeddings")
def gather_padded(spark, d):
    i = F.col("vec_id")
    return table(spark, d, "embeddings").select(i.alias("qid"), retrieval.pad_missing(F.array(i, i - 3, i - 6), 5).alias("ids"))


@query("remap_ids", f"WITH {_HITS} SELECT qid, pid, doc_id, rank FROM hits JOIN (SELECT vec_id, vec_id * 7 + 1 AS doc_id FROM embeddings) m ON m.vec_id = pid WHERE rank <= 3")
def remap_ids(spark, d):
    mapped = table(spark, d, "embeddings").select(F.col("vec_id").alias("pid"), (F.col("vec_id") * 7 + 1).alias("doc_id"))
    return _hits(spark, d, 3).join(mapped, "pid").select("qid", "pid", "doc_id", "rank")
