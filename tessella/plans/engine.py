"""Engine features beyond the reference: joins of every kind, grouping sets, windows, set operations, table functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import procedural as P
from ..functions import text as T
from ..functions import vector as V
from ..operators import joins as J
from ..operators import mapping as M
from ..operators.retrieval import gather, knn, attach_neighbors
from .registry import query, table


@query("full_outer_join", "SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nation, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM customer c FULL JOIN supplier s ON c.c_nationkey = s.s_nationkey GROUP BY 1")
def full_outer_join(spark, d):
    """Counts by key on either side before the join, so that it never pairs all rows of a key."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full").na.fill(0, ["customers", "suppliers"])


@query("star_join", "SELECT r_name, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def star_join(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("asof_join", "SELECT e.event_id, p.value AS last_purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof_join(spark, d):
    e = table(spark, d, "events")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase"))
    return J.asof_join(e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "last_purchase").select("event_id", "last_purchase")


@query("range_join", "SELECT p_partkey, b.lo FROM part, (SELECT CAST(unnest([900.0, 920.0, 940.0]) AS DOUBLE) AS lo) b WHERE p_retailprice >= lo AND p_retailprice < lo + 30")
def range_join(spark, d):
    ranges = spark.createDataFrame([(900.0, 930.0), (920.0, 950.0), (940.0, 970.0)], "lo double, hi double")
    return J.range_join(table(spark, d, "part"), ranges, "p_retailprice", "lo", "hi", 30.0).select("p_partkey", "lo")


@query("rollup_sales", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_sales(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("cube_events", "SELECT event_type, user_id % 3 AS third, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 3)")
def cube_events(spark, d):
    return table(spark, d, "events").select("event_type", F.pmod("user_id", F.lit(3)).alias("third")).cube("event_type", "third").agg(F.count("*").alias("n"))


@query("window_ranks", "SELECT c_custkey, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS percent, lag(c_custkey) OVER w AS before FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)")
def window_ranks(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("percent"), F.lag("c_custkey").over(w).alias("before"))


@query("set_operations", "(SELECT c_nationkey AS k, 'both' AS kind FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT c_nationkey, 'customers' FROM customer EXCEPT SELECT s_nationkey, 'customers' FROM supplier)")
def set_operations(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("kind", F.lit("both")).unionByName(c.subtract(s).withColumn("kind", F.lit("customers")))


@query("approximate_distinct")
def approximate_distinct(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_sketch_agg("user_id")).alias("users"))


@query("grouped_python_aggregate", "SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def grouped_python_aggregate(spark, d):
    @F.pandas_udf("double")
    def mean(x: pd.Series) -> float:
        return float(x.mean())

    return table(spark, d, "events").groupBy("event_type").agg(F.round(mean("value"), 6).alias("mean"))


@query("mapped_batches", "SELECT event_id, upper(event_type) AS kind FROM events WHERE value > 10")
def mapped_batches(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    kept = M.filter_rows(e, lambda pdf: pdf.value > 10)
    return M.map_batches(kept, lambda pdf: pd.DataFrame({"event_id": pdf.event_id, "kind": pdf.event_type.str.upper()}), "event_id long, kind string")


@query("retriever", "SELECT qid, coalesce(list(text ORDER BY rank) FILTER (WHERE text IS NOT NULL), []) AS docs FROM (SELECT q.vec_id AS qid, c.vec_id AS pid, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) DESC, c.vec_id) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0) LEFT JOIN documents ON doc_id = pid WHERE rank <= 5 GROUP BY 1")
def retriever(spark, d):
    """Vectors in, documents out: search, attach, gather."""
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 20 = 0")
    lists = attach_neighbors(asked.select(F.col("vec_id").alias("qid")), knn(asked, v, 5))
    return gather(lists, table(spark, d, "documents"), "qid", "neighbors", "doc_id", "text", "docs")


@query("first_answer", "SELECT conv_id, list(text ORDER BY turn)[1] AS answer FROM conversations WHERE text IS NOT NULL GROUP BY 1 HAVING length(list(text ORDER BY turn)[1]) > 0")
def first_answer(spark, d):
    g = table(spark, d, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("a"))
    a = g.select("conv_id", F.transform("a", lambda x: x["text"]).alias("answers"))
    return a.where((F.size("answers") > 0) & (F.length(F.element_at("answers", 1)) > 0)).select("conv_id", F.element_at("answers", 1).alias("answer"))


@query("token_count", "SELECT item_id, len(regexp_extract_all(strip_accents(lower(text || chr(10) || chr(10) || 'The answer is:')), '[!-/:-@\\[-`{-~\\p{P}]|[^\\s!-/:-@\\[-`{-~\\p{P}]+')) AS n FROM benchmark")
def token_count(spark, d):
    """Tokens of a question with its prompt; any tokenizer expression can stand for basic_tokens."""
    return table(spark, d, "benchmark").select("item_id", F.size(T.basic_tokens(F.concat("text", F.lit("\n\nThe answer is:")))).cast("long").alias("n"))


@query("rescale", "SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round((x / 255 - 0.5) / 0.25, 6)) AS v FROM embeddings")
def rescale(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(V.doubles(F.col("embedding")), lambda x: V.rounded((x / 255 - 0.5) / 0.25, 6)).alias("v"))


@query("patch_boxes", "SELECT p_partkey, round((p_size % 32) / 32.0, 6) AS x0, round((p_size % 32) / 32.0 + 1 / 32.0, 6) AS x1 FROM part")
def patch_boxes(spark, d):
    n = F.pmod("p_size", F.lit(32))
    return table(spark, d, "part").select("p_partkey", V.patch_box(n, n, 32).alias("b")).select("p_partkey", F.round("b.x0", 6).alias("x0"), F.round("b.x1", 6).alias("x1"))


@query("spectrogram")
def spectrogram(spark, d):
    """Power spectra of embeddings read as waves."""
    s = table(spark, d, "embeddings").select("vec_id", P.spectrogram_udf(16, 8)(F.col("embedding").cast("array<double>")).alias("s"))
    return s.select("vec_id", F.posexplode("s").alias("frame", "power"))


@query("filter_banks")
def filter_banks(spark, d):
    """Mel and chroma filters as small tables."""
    rows = [(name, i, m[i].tolist()) for name, m in (("mel", P.mel_filters(129, 20, 0.0, 4000.0, 8000)), ("chroma", P.chroma_filters(129, 12, 8000))) for i in range(len(m))]
    return spark.createDataFrame(rows, "bank string, bin int, weights array<double>")


@query("word_level_answers", "SELECT item_id, array_to_string((list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))[3:6], ' ') AS answer FROM benchmark")
def word_level_answers(spark, d):
    """Words 2 to 5 of each text, joined."""
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(T.tokens(F.col("text")), 3, 4), " ").alias("answer"))


@query("passage_spans", """WITH s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r, event_type FROM events),
p AS (SELECT user_id, event_type, max(value) AS relevance FROM events GROUP BY ALL)
SELECT user_id, event_id, CAST(n AS INT) AS place FROM (SELECT s.user_id, event_id, row_number() OVER (PARTITION BY s.user_id ORDER BY relevance DESC, s.event_type, r) AS n FROM s JOIN p USING (user_id, event_type) WHERE r <= 3) WHERE n <= 5""")
def passage_spans(spark, d):
    """Spans by passage in order of relevance, three from each, five in all."""
    e = table(spark, d, "events")
    best = e.withColumn("r", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.col("value").desc(), "event_id"))).where("r <= 3")
    rel = e.groupBy("user_id", "event_type").agg(F.max("value").alias("relevance"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("relevance").desc(), "event_type", "r"))
    return best.join(rel, ["user_id", "event_type"]).withColumn("place", n).where("place <= 5").select("user_id", "event_id", "place")
