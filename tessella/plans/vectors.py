"""Vector, pooling, decoding-filter, padding and chunking queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import decode as D
from ..functions import vector as V
from ..operators import sequences as S
from .registry import query, table

_E = "CAST(embedding AS DOUBLE[])"
_R = "list_transform({0}, lambda x: round(x, 6))"


def emb(spark, d):
    return table(spark, d, "embeddings")


def r6(c):
    return F.transform(c, lambda x: V.rounded(x, 6))


@query("inner_product", f"SELECT vec_id, round(list_dot_product({_E}, list_reverse({_E})), 6) AS score FROM embeddings")
def inner_product(spark, d):
    return emb(spark, d).select("vec_id", V.rounded(V.dot(F.col("embedding"), F.reverse("embedding")), 6).alias("score"))


@query("l2_normalize", f"SELECT vec_id, {_R.format(f'list_transform({_E}, lambda x: x / sqrt(list_dot_product({_E}, {_E})))')} AS unit FROM embeddings")
def l2_normalize(spark, d):
    return emb(spark, d).select("vec_id", r6(V.l2_normalize(F.col("embedding"))).alias("unit"))


@query("overwrite_row", "SELECT vec_id, CASE WHEN vec_id = 51 THEN [CAST(1 AS FLOAT), 1] ELSE embedding[1:2] END AS head FROM embeddings")
def overwrite_row(spark, d):
    one = F.lit(1.0).cast("float")
    return emb(spark, d).select("vec_id", F.when(F.col("vec_id") == 51, F.array(one, one)).otherwise(F.slice("embedding", 1, 2)).alias("head"))


_HALVES = f"[list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)), list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE))]"


def halves(spark, d):
    """Two token vectors for each row: the halves of its embedding."""
    h = lambda a: F.slice("embedding", a, 32).cast("array<double>")
    return emb(spark, d).select("vec_id", F.array(h(1), h(33)).alias("tokens"))


@query("mean_pool", f"SELECT vec_id, {_R.format('list_transform(list_zip(t[1], t[2]), lambda z: (z[1] + z[2]) / 2)')} AS pooled FROM (SELECT vec_id, {_HALVES} AS t FROM embeddings)")
def mean_pool(spark, d):
    return halves(spark, d).select("vec_id", r6(V.mean_pool(F.col("tokens"), F.array(F.lit(1), F.lit(1)))).alias("pooled"))


@query("weighted_pool", f"SELECT vec_id, {_R.format('list_transform(list_zip(t[1], t[2]), lambda z: (z[1] + 2 * z[2]) / 3)')} AS pooled FROM (SELECT vec_id, {_HALVES} AS t FROM embeddings)")
def weighted_pool(spark, d):
    return halves(spark, d).select("vec_id", r6(V.mean_pool(F.col("tokens"), F.array(F.lit(1), F.lit(1)), weighted=True)).alias("pooled"))


@query("first_last_pool", f"SELECT vec_id, t[1] AS first, t[2] AS last FROM (SELECT vec_id, {_HALVES} AS t FROM embeddings)")
def first_last_pool(spark, d):
    return halves(spark, d).select("vec_id", V.first_pool(F.col("tokens")).alias("first"), V.last_pool(F.col("tokens")).alias("last"))


@query("moving_mean", "SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def moving_mean(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-99, Window.currentRow)
    return table(spark, d, "events").select("event_id", "user_id", V.rounded(F.avg("value").over(w), 6).alias("mean"))


@query("cumulative_mean", "SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def cumulative_mean(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, d, "events").select("event_id", "user_id", V.rounded(F.avg("value").over(w), 6).alias("mean"))


@query("append_accumulator", "SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def append_accumulator(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return g.select("conv_id", F.transform("r", lambda x: x["role"]).alias("roles"))


_EXP = f"list_transform({_E}, lambda x: exp(x - list_max({_E})))"
_SOFT = f"(SELECT vec_id, list_transform({_EXP}, lambda x: x / list_sum({_EXP})) AS p FROM embeddings)"


@query("softmax", f"SELECT vec_id, {_R.format('p')} AS p FROM {_SOFT}")
def softmax(spark, d):
    return emb(spark, d).select("vec_id", r6(V.softmax(V.doubles(F.col("embedding")))).alias("p"))


@query("sigmoid", f"SELECT vec_id, list_transform({_E}, lambda x: round(1 / (1 + exp(-x)), 6)) AS p FROM embeddings")
def sigmoid(spark, d):
    return emb(spark, d).select("vec_id", F.transform(V.doubles(F.col("embedding")), lambda x: V.rounded(V.sigmoid(x), 6)).alias("p"))


def logits(spark, d):
    """vec_id, token, logit: one row for each candidate token of each vector."""
    return emb(spark, d).select("vec_id", F.posexplode("embedding").alias("token", "logit")).withColumn("logit", F.col("logit").cast("double"))


_LOGITS = "lg AS (SELECT vec_id, unnest(range(0, 64)) AS token, CAST(unnest(embedding) AS DOUBLE) AS logit FROM embeddings)"


@query("softmax_rank", f"WITH {_LOGITS}, m AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM lg) SELECT * FROM (SELECT vec_id, CAST(token AS INT) AS token, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token) AS INT) AS rank FROM m) WHERE rank <= 5")
def softmax_rank(spark, d):
    return D.ranked(logits(spark, d), "vec_id", "token", "logit", 5).select("vec_id", "token", V.rounded("p", 6).alias("p"), "rank")


@query("topk_filter", f"WITH {_LOGITS} SELECT vec_id, CAST(token AS INT) AS token FROM (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY logit DESC) AS r FROM lg) WHERE r <= 7")
def topk_filter(spark, d):
    return D.top_k(logits(spark, d), "vec_id", "logit", 7).select("vec_id", "token")


_CUM = f"WITH {_LOGITS}, m AS (SELECT *, exp(logit * 10 - max(logit * 10) OVER (PARTITION BY vec_id)) AS e FROM lg), p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM m), c AS (SELECT *, round(coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS b FROM p)"


@query("topp_filter", f"{_CUM} SELECT vec_id, CAST(token AS INT) AS token FROM c WHERE b <= 0.5")
def topp_filter(spark, d):
    return D.top_p(logits(spark, d).withColumn("logit", F.col("logit") * 10), "vec_id", "token", "logit", 0.5).select("vec_id", "token")


@query("topp_filter_strict", f"{_CUM} SELECT vec_id, CAST(token AS INT) AS token FROM c WHERE b < 0.5")
def topp_filter_strict(spark, d):
    return D.top_p(logits(spark, d).withColumn("logit", F.col("logit") * 10), "vec_id", "token", "logit", 0.5, inclusive=False).select("vec_id", "token")


@query("temperature", f"WITH {_LOGITS} SELECT vec_id, CAST(token AS INT) AS token, round(logit / 0.7, 6) AS logit FROM lg")
def temperature(spark, d):
    return logits(spark, d).select("vec_id", "token", V.rounded(F.col("logit") / 0.7, 6).alias("logit"))


@query("minimum_length", f"WITH {_LOGITS} SELECT vec_id, CAST(token AS INT) AS token, CASE WHEN token = 3 AND vec_id % 8 < 5 THEN -1e9 ELSE round(logit, 6) END AS logit FROM lg")
def minimum_length(spark, d):
    return logits(spark, d).select("vec_id", "token", D.minimum_length(V.rounded("logit", 6), F.col("token"), F.pmod("vec_id", F.lit(8)), 5, 3, -1e9).alias("logit"))


@query("repetition_penalty", f"WITH {_LOGITS} SELECT vec_id, CAST(token AS INT) AS token, round(CASE WHEN token % 5 <> vec_id % 5 THEN logit WHEN logit < 0 THEN logit * 1.3 ELSE logit / 1.3 END, 6) AS logit FROM lg")
def repetition_penalty(spark, d):
    base = logits(spark, d)
    seen = base.where(F.pmod("token", F.lit(5)) == F.pmod("vec_id", F.lit(5))).select("vec_id", "token")
    return D.repetition_penalty(base, seen, "vec_id", "token", "logit", 1.3).select("vec_id", "token", V.rounded("logit", 6).alias("logit"))


_SEQ = "list_transform(range(1, 13), lambda i: (l_partkey * i * i + l_suppkey) % 4)"


def sequences(spark, d):
    """A short sequence of small numbers for each line item."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.pmod(F.col("l_partkey") * i * i + F.col("l_suppkey"), F.lit(4))).alias("ids"))


@query("no_repeat_ngram", f"SELECT l_orderkey, l_linenumber, list_sort(list_distinct(list_transform(list_filter(range(1, 11), lambda i: ids[i] = ids[11] AND ids[i + 1] = ids[12]), lambda i: ids[i + 2]))) AS banned FROM (SELECT l_orderkey, l_linenumber, {_SEQ} AS ids FROM lineitem)")
def no_repeat_ngram(spark, d):
    return sequences(spark, d).select("l_orderkey", "l_linenumber", F.array_sort(D.banned_by_ngram(F.col("ids"), 3)).alias("banned"))


@query("bad_words", f"SELECT l_orderkey, l_linenumber, list_concat(CASE WHEN ids[12] = 1 THEN [2] ELSE [] END, CASE WHEN ids[11:12] = [0, 0] THEN [3] ELSE [] END, [9]) AS banned FROM (SELECT l_orderkey, l_linenumber, {_SEQ} AS ids FROM lineitem)")
def bad_words(spark, d):
    return sequences(spark, d).select("l_orderkey", "l_linenumber", D.banned_words(F.col("ids"), [[1, 2], [0, 0, 3], [9]]).alias("banned"))


@query("forced_tokens", f"WITH {_LOGITS} SELECT vec_id, CAST(token AS INT) AS token, CASE WHEN token = 7 THEN 0.0 ELSE -1e9 END AS logit FROM lg")
def forced_tokens(spark, d):
    return logits(spark, d).select("vec_id", "token", D.forced(F.col("token"), 7, -1e9).alias("logit"))


@query("suppressed_tokens", f"WITH {_LOGITS} SELECT vec_id, CAST(token AS INT) AS token, CASE WHEN token IN (1, 2) THEN -1e9 ELSE round(logit, 6) END AS logit FROM lg")
def suppressed_tokens(spark, d):
    return logits(spark, d).select("vec_id", "token", D.suppressed(V.rounded("logit", 6), F.col("token"), [1, 2], -1e9).alias("logit"))


@query("stop_rules", f"SELECT l_orderkey, l_linenumber, len(ids) >= 20 OR ids[12] = 3 OR list_has_any([array_to_string(ids, '')], ['']) OR contains(array_to_string(ids, ''), '012') AS stop FROM (SELECT l_orderkey, l_linenumber, {_SEQ} AS ids FROM lineitem)")
def stop_rules(spark, d):
    ids = F.col("ids")
    return sequences(spark, d).select("l_orderkey", "l_linenumber", D.stops(ids, F.array_join(ids.cast("array<string>"), ""), 20, 3, ["012"]).alias("stop"))


@query("prompt_lookup", f"SELECT l_orderkey, l_linenumber, coalesce(ids[a + 2 : least(a + 4, 12)], ids[b + 1 : least(b + 3, 12)], []) AS candidate FROM (SELECT *, list_min(list_filter(range(1, 11), lambda i: ids[i] = ids[11] AND ids[i + 1] = ids[12])) AS a, list_min(list_filter(range(1, 12), lambda i: ids[i] = ids[12])) AS b FROM (SELECT l_orderkey, l_linenumber, {_SEQ} AS ids FROM lineitem))")
def prompt_lookup(spark, d):
    return sequences(spark, d).select("l_orderkey", "l_linenumber", D.prompt_lookup(F.col("ids"), 2, 3).alias("candidate"))


@query("phrase_trie", "WITH p AS (SELECT DISTINCT string_split(p_name, ' ') AS w FROM part), x AS (SELECT w, unnest(range(0, len(w))) AS n FROM p) SELECT array_to_string(w[1:n], ' ') AS prefix, list_sort(list(DISTINCT w[n + 1])) AS next FROM x GROUP BY 1")
def phrase_trie(spark, d):
    return D.trie(table(spark, d, "part").select(F.split("p_name", " ").alias("words")), "words")


@query("zero_shot", "SELECT vec_id, round(exp(CAST(embedding[1] AS DOUBLE)) / (exp(CAST(embedding[1] AS DOUBLE)) + exp(CAST(embedding[2] AS DOUBLE))), 6) AS entailed FROM embeddings")
def zero_shot(spark, d):
    e = lambda i: F.exp(F.element_at("embedding", i).cast("double"))
    return emb(spark, d).select("vec_id", V.rounded(e(1) / (e(1) + e(2)), 6).alias("entailed"))


_ZS = "SELECT vec_id, unnest(range(0, 16)) AS label, CAST(unnest(embedding[1:32:2]) AS DOUBLE) AS c, CAST(unnest(embedding[2:32:2]) AS DOUBLE) AS e FROM embeddings"


@query("zero_shot_labels", f"SELECT vec_id, CAST(label AS INT) AS label, round(exp(e) / sum(exp(e)) OVER (PARTITION BY vec_id), 6) AS one_of_all, round(exp(e) / (exp(c) + exp(e)), 6) AS each_alone FROM ({_ZS})")
def zero_shot_labels(spark, d):
    """Sixteen labels with scores for contradiction and entailment: as one of all labels, and each alone."""
    pick = lambda k: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.element_at("embedding", 2 * i + k).cast("double"))
    scored = emb(spark, d).select("vec_id", D.label_scores(pick(1), pick(2), False).alias("one"), D.label_scores(pick(1), pick(2), True).alias("each"))
    return scored.select("vec_id", F.posexplode(F.arrays_zip("one", "each")).alias("label", "s")).select("vec_id", "label", V.rounded("s.one", 6).alias("one_of_all"), V.rounded("s.each", 6).alias("each_alone"))


@query("signal_windows", "SELECT name, list_transform(range(0, 16), lambda i: round(CASE name WHEN 'boxcar' THEN 1.0 WHEN 'hamming' THEN 0.54 - 0.46 * cos(2 * pi() * i / 16) WHEN 'hann' THEN 0.5 - 0.5 * cos(2 * pi() * i / 16) ELSE pow(0.5 - 0.5 * cos(2 * pi() * i / 16), 0.85) END, 6)) AS weights FROM (SELECT unnest(['boxcar', 'hamming', 'hann', 'povey']) AS name)")
def signal_windows(spark, d):
    one = lambda name: spark.range(1).select(F.lit(name).alias("name"), F.transform(V.signal_window(16, name), lambda x: V.rounded(x, 6)).alias("weights"))
    return one("boxcar").union(one("hamming")).union(one("hann")).union(one("povey"))


@query("in_sequence_norm", f"SELECT vec_id, list_concat(list_transform(x, lambda v: round((v - list_avg(x)) / sqrt(list_var_pop(x) + 1e-7), 5)), [0.0, 0.0, 0.0, 0.0]) AS z FROM (SELECT vec_id, {_E}[1:60] AS x FROM embeddings)")
def in_sequence_norm(spark, d):
    return emb(spark, d).select("vec_id", F.transform(V.standardize(F.col("embedding"), F.lit(60)), lambda x: V.rounded(x, 5)).alias("z"))


@query("feature_norm", "SELECT event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z FROM events WINDOW w AS (PARTITION BY user_id)")
def feature_norm(spark, d):
    e = table(spark, d, "events")
    stats = e.groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return e.join(stats, "user_id").select("event_id", V.rounded((F.col("value") - F.col("m")) / F.col("s"), 6).alias("z"))


@query("pad_right", "SELECT conv_id, list_concat(t, list_transform(range(0, 16 - len(t)), lambda i: -1)) AS padded, list_concat(list_transform(t, lambda x: 1), list_transform(range(0, 16 - len(t)), lambda i: 0)) AS mask FROM (SELECT conv_id, list(turn ORDER BY turn) AS t FROM (SELECT conv_id, CAST(turn AS INT) AS turn FROM conversations) GROUP BY 1)")
def pad_right(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.col("turn").cast("int"))).alias("t"))
    n = V.round_up(F.size("t"), 16)
    return g.select("conv_id", V.padded(F.col("t"), n, F.lit(-1)).alias("padded"), V.padded(F.transform("t", lambda _: F.lit(1)), n, F.lit(0)).alias("mask"))


@query("truncate", "SELECT vec_id, embedding[1:16] AS head FROM embeddings")
def truncate(spark, d):
    return emb(spark, d).select("vec_id", V.truncated(F.col("embedding"), 10, 8).alias("head"))


_W = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"


def words(spark, d):
    from ..functions.text import tokens

    return table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("w"))


@query("fixed_blocks", f"SELECT doc_id, k AS block, array_to_string(w[k * 128 + 1 : k * 128 + 128], ' ') AS part FROM (SELECT doc_id, w, unnest(range(0, len(w) // 128)) AS k FROM (SELECT doc_id, {_W} AS w FROM documents))")
def fixed_blocks(spark, d):
    return words(spark, d).select("doc_id", F.posexplode(S.fixed_blocks(F.col("w"), 128)).alias("block", "p")).select("doc_id", F.col("block").cast("long").alias("block"), F.array_join("p", " ").alias("part"))


@query("packed_blocks", f"WITH b AS (SELECT doc_id, {_W} AS w, (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS batch FROM documents), s AS (SELECT batch, w, sum(len(w)) OVER (PARTITION BY batch ORDER BY doc_id) - len(w) AS start FROM b), p AS (SELECT batch, start + i AS pos, w[i + 1] AS x FROM (SELECT batch, start, w, unnest(range(0, len(w))) AS i FROM s)) SELECT batch, CAST(pos // 128 AS BIGINT) AS block, md5(string_agg(x, ' ' ORDER BY pos)) AS part FROM p GROUP BY 1, 2 HAVING count(*) = 128")
def packed_blocks(spark, d):
    """Batches of 1000 documents, each packed into blocks of 128 words."""
    from ..operators.order import with_row_number

    rows = with_row_number(words(spark, d), "doc_id", name="row").withColumn("batch", F.floor(F.col("row") / 1000))
    return S.packed_blocks(rows, 128, "batch", "doc_id", "w").select("batch", "block", F.md5(F.array_join("part", " ")).alias("part"))


@query("stride_chunks", f"SELECT doc_id, s AS start, CAST(len(w[s + 1 : s + 384]) AS BIGINT) AS n, md5(array_to_string(w[s + 1 : s + 384], ' ')) AS part FROM (SELECT doc_id, w, unnest(list_filter(range(0, len(w), 128), lambda s: s = 0 OR s - 128 + 384 < len(w))) AS s FROM (SELECT doc_id, {_W} AS w FROM documents))")
def stride_chunks(spark, d):
    x = words(spark, d).select("doc_id", F.explode(S.strided_chunks(F.col("w"), 384, 128)).alias("c"))
    return x.select("doc_id", F.col("c.start").cast("long").alias("start"), F.size("c.part").cast("long").alias("n"), F.md5(F.array_join("c.part", " ")).alias("part"))


@query("sliding_window_ppl", f"SELECT doc_id, b AS begin, least(b + 512, n) AS end_, least(b + 512, n) - CASE WHEN b = 0 THEN 0 ELSE least(b - 256 + 512, n) END AS scored FROM (SELECT doc_id, n, unnest(list_filter(range(0, n, 256), lambda b: b = 0 OR b - 256 + 512 < n)) AS b FROM (SELECT doc_id, len({_W}) AS n FROM documents))")
def sliding_window_ppl(spark, d):
    x = words(spark, d).select("doc_id", F.explode(S.scoring_windows(F.size("w"), 512, 256)).alias("c"))
    return x.select("doc_id", F.col("c.begin").cast("long").alias("begin"), F.col("c.end").cast("long").alias("end_"), F.col("c.scored").cast("long").alias("scored"))


@query("max_context", f"WITH c AS (SELECT doc_id, s, len(w[s + 1 : s + 384]) AS n FROM (SELECT doc_id, w, unnest(list_filter(range(0, len(w), 128), lambda s: s = 0 OR s - 128 + 384 < len(w))) AS s FROM (SELECT doc_id, {_W} AS w FROM documents))), p AS (SELECT doc_id, s, n, unnest([100, 200, 300, 400]) AS pos FROM c) SELECT doc_id, CAST(pos AS INT) AS position, arg_min(s, (-(least(pos - s, s + n - 1 - pos) + 0.01 * n), s)) AS chunk_start FROM p WHERE pos >= s AND pos < s + n GROUP BY ALL")
def max_context(spark, d):
    chunks = stride_chunks(spark, d)
    return S.max_context_chunk(chunks, ["doc_id"], "start", "n", F.array(*map(F.lit, (100, 200, 300, 400))))


@query("byte_chunks", "WITH c AS (SELECT doc_id, n, unnest(list_filter(range(0, n + 1, 800), lambda s: s + 1000 <= n OR (n - s > 100 AND (s = 0 OR s - 800 + 1000 <= n)))) AS s FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)) SELECT doc_id, s AS start, least(1000, n - s) AS n, CASE WHEN s = 0 THEN 0 ELSE 100 END AS left_, CASE WHEN s + 1000 <= n THEN 100 ELSE 0 END AS right_ FROM c")
def byte_chunks(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.explode(S.byte_chunks(F.encode("text", "UTF-8"), 1000, 100, 100)).alias("c"))
    return x.select("doc_id", F.col("c.start").cast("long").alias("start"), F.col("c.n").cast("long").alias("n"), F.col("c.left").alias("left_"), F.col("c.right").alias("right_"))


@query("sink_cache", "SELECT conv_id, list_filter(range(0, n), lambda p: p < 1 OR p >= n - 2) AS kept FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)")
def sink_cache(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", V.sink_positions(F.col("n"), 1, 3).cast("array<bigint>").alias("kept"))


@query("box_iou", "WITH b AS (SELECT p_partkey, p_size, p_retailprice / 100 AS s FROM part) SELECT p_partkey, round(greatest(least(s, 12.0) - 3, 0) * 10 / (s * 10 + 90 - greatest(least(s, 12.0) - 3, 0) * 10), 6) AS iou FROM b")
def box_iou(spark, d):
    s = F.col("p_retailprice") / 100
    box = lambda x0, x1: F.struct(x0.alias("x0"), F.lit(0.0).alias("y0"), x1.alias("x1"), F.lit(10.0).alias("y1"))
    return table(spark, d, "part").select("p_partkey", V.rounded(V.iou(box(F.lit(0.0), s), box(F.lit(3.0), F.lit(12.0))), 6).alias("iou"))


@query("box_formats", "SELECT p_partkey, p_size - 1.5 AS x0, p_size + 1.5 AS x1, CAST(1000 * (p_size / 64.0) AS INT) AS gx FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part)".replace("CAST(1000 * (p_size / 64.0) AS INT)", "CAST(trunc(1000 * (p_size / 64.0)) AS INT)"))
def box_formats(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"))
    return p.select("p_partkey", V.center_to_corners(F.col("s"), F.col("s"), F.lit(3.0), F.lit(1.0)).alias("b"), V.box_to_grid(F.col("s"), F.lit(64.0)).alias("gx")).select("p_partkey", "b.x0", "b.x1", "gx")


@query("patch_grid", "WITH b AS (SELECT p_partkey, (p_size % 8) / 10.0 AS x, (p_partkey % 8) / 10.0 AS y FROM part) SELECT p_partkey, CAST(floor(y * 32) * 32 + floor(x * 32) AS BIGINT) AS ul, CAST((ceil((y + 0.15) * 32) - 1) * 32 + ceil((x + 0.15) * 32) - 1 AS BIGINT) AS lr FROM b")
def patch_grid(spark, d):
    x, y = F.pmod("p_size", F.lit(8)) / 10.0, F.pmod("p_partkey", F.lit(8)) / 10.0
    return table(spark, d, "part").select("p_partkey", V.patch_index(x, y, x + 0.15, y + 0.15, 32).alias("p")).select("p_partkey", "p.ul", "p.lr")


@query("db_scale", "SELECT event_id, round(10 * log10(greatest(value, 1e-10)), 6) AS db, round(20 * log10(greatest(value, 1e-5)), 6) AS amp FROM events")
def db_scale(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", V.rounded(V.decibels(v), 6).alias("db"), V.rounded(V.decibels(v, least=1e-5, power=False), 6).alias("amp"))


@query("mel_scale", "SELECT event_id, round(2595.0 * log10(1 + h / 700.0), 6) AS htk, round(1127.0 * ln(1 + h / 700.0), 6) AS kaldi, round(CASE WHEN h >= 1000 THEN 15 + ln(h / 1000) * 27 / ln(6.4) ELSE 3 * h / 200 END, 6) AS slaney, round(log2(greatest(h, 1) / 27.5), 6) AS octave FROM (SELECT event_id, abs(value) * 40 AS h FROM events)")
def mel_scale(spark, d):
    h = F.abs("value") * 40
    return table(spark, d, "events").select("event_id", *[V.rounded(V.hertz_to_mel(h, s), 6).alias(s) for s in ("htk", "kaldi", "slaney")], V.rounded(V.hertz_to_octave(F.greatest(h, F.lit(1.0))), 6).alias("octave"))


@query("color_ids", "SELECT p_partkey, p_size % 256 + 256 * (p_partkey % 256) + 65536 * 3 AS id FROM part")
def color_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", V.rgb_to_id(F.pmod("p_size", F.lit(256)), F.pmod("p_partkey", F.lit(256)), F.lit(3)).alias("id"))


@query("distribution_parameters", "SELECT event_id, round(2 + (value + sqrt(value * value + 4)) / 2, 6) AS df FROM events")
def distribution_parameters(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", V.rounded(V.student_parameters(v, v, v)["df"], 6).alias("df"))
