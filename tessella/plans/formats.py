"""Round trips through every sink and source: what is written is what is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.retrieval import knn
from ..operators.storage import new_path
from ..sources import readers as R
from ..sources import sinks as W
from .registry import query, table


def scratch(spark) -> str:
    return new_path(spark, "io")


@query("json_lines_round_trip", "SELECT doc_id AS id, text AS contents FROM documents")
def json_lines_round_trip(spark, d):
    path = scratch(spark)
    W.save_json_lines(table(spark, d, "documents"), path, "doc_id", "text", rows=250)
    return spark.read.json(path, schema="id BIGINT, contents STRING")


@query("columnar_round_trip", "SELECT doc_id, lang, source FROM documents")
def columnar_round_trip(spark, d):
    path = scratch(spark)
    W.save_columnar(table(spark, d, "documents").select("doc_id", "lang", "source"), path)
    return R.read_columnar(spark, path)


@query("hits_round_trip", "SELECT qid, pid, CAST(rank AS INT) AS rank FROM (SELECT q.vec_id AS qid, c.vec_id AS pid, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) DESC, c.vec_id) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0) WHERE rank <= 3")
def hits_round_trip(spark, d):
    v, path = table(spark, d, "embeddings"), scratch(spark)
    W.save_hits(knn(v.where("vec_id % 20 = 0"), v, 3), path)
    return R.read_hits(spark, path).select("qid", "pid", "rank")


@query("ngram_round_trip", "SELECT event_type AS ngram, count(*) AS cnt FROM events GROUP BY 1")
def ngram_round_trip(spark, d):
    path = scratch(spark)
    W.save_ngrams(table(spark, d, "events").groupBy(F.col("event_type").alias("ngram")).agg(F.count("*").alias("cnt")), path)
    return R.read_tsv(spark, path, "ngram STRING, cnt BIGINT")


@query("vector_round_trip", "SELECT vec_id, embedding FROM embeddings")
def vector_round_trip(spark, d):
    path = scratch(spark)
    W.save_vectors(table(spark, d, "embeddings"), path)
    return R.read_any(spark, path + "/*.parquet")


@query("nested_qa", "SELECT conv_id AS id, list(text ORDER BY turn)[1] AS answer_text FROM conversations WHERE text IS NOT NULL GROUP BY 1".replace("conv_id AS id", "CAST(conv_id AS VARCHAR) AS id"))
def nested_qa(spark, d):
    """Conversations written as a nested question answering file, one object a line, and flattened again."""
    path = scratch(spark)
    c = table(spark, d, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    answers = F.transform("t", lambda x: F.struct(x["text"].alias("text"), x["turn"].cast("bigint").alias("answer_start")))
    qas = F.array(F.struct(F.col("conv_id").cast("string").alias("id"), F.lit("q").alias("question"), F.lit(False).alias("is_impossible"), answers.alias("answers")))
    data = F.array(F.struct(F.lit("t").alias("title"), F.array(F.struct(F.lit("c").alias("context"), qas.alias("qas"))).alias("paragraphs")))
    c.select(F.lit("1").alias("version"), data.alias("data")).write.json(path)
    flat = spark.read.json(path, schema=R.QA_SCHEMA).select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p")).select(F.explode("p.qas").alias("q"))
    return flat.select(F.col("q.id").alias("id"), F.element_at("q.answers", 1)["text"].alias("answer_text"))


@query("lines", "SELECT trim(line) AS line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '\\S') GROUP BY 1".replace("trim(line) AS line", "line"))
def lines(spark, d):
    path = scratch(spark)
    table(spark, d, "documents").where("text IS NOT NULL").select("text").write.text(path)
    return R.read_lines(spark, path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))
