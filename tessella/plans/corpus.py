"""Corpus preparation queries: projections, filters, sharding, n-grams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import language as L
from ..operators import order as O
from ..operators import phrases as P
from .registry import query, table

_WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"


def docs(spark, d):
    return table(spark, d, "documents")


@query("word_count", f"SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_words FROM documents")
def word_count(spark, d):
    return docs(spark, d).select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query("length_band", f"SELECT doc_id, n AS n_words FROM (SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n FROM documents) WHERE n BETWEEN 64 AND 128")
def length_band(spark, d):
    return word_count(spark, d).where(F.col("n_words").between(64, 128))


@query("length_sort", f"SELECT doc_id, n_words, row_number() OVER (ORDER BY n_words DESC, doc_id) - 1 AS place FROM (SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_words FROM documents)")
def length_sort(spark, d):
    counted = word_count(spark, d).withColumn("neg", (-F.col("n_words")).cast("double"))
    return O.with_row_number(counted, "neg", "doc_id", name="place").drop("neg")


@query("non_empty", "SELECT doc_id FROM documents WHERE length(text) > 0")
def non_empty(spark, d):
    return docs(spark, d).where(F.length("text") > 0).select("doc_id")


@query("first_n", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def first_n(spark, d):
    return docs(spark, d).orderBy("doc_id").limit(100).select("doc_id", "n_chars")


@query("row_id", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents")
def row_id(spark, d):
    return O.with_row_number(docs(spark, d).select("doc_id"), "doc_id")


@query("rename_first", "SELECT o_orderkey AS question_id, o_orderpriority AS question, string_split(o_orderpriority, '-')[1] AS answer FROM orders")
def rename_first(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("question"), F.element_at(F.split("o_orderpriority", "-"), 1).alias("answer"))


@query("tolerant_pick", "SELECT item_id AS id, coalesce(text, '') AS question FROM benchmark UNION ALL SELECT conv_id, coalesce(text, '') FROM conversations WHERE turn = 0")
def tolerant_pick(spark, d):
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query"))
    b = table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("id"), F.col("text").alias("question"))
    return a.unionByName(b, allowMissingColumns=True).select("id", F.coalesce("query", "question", F.lit("")).alias("question"))


@query("title_text", "SELECT doc_id, source || ' [SEP] ' || text AS full_text FROM documents")
def title_text(spark, d):
    return docs(spark, d).select("doc_id", F.concat("source", F.lit(" [SEP] "), "text").alias("full_text"))


@query("prefix_template", "SELECT doc_id, 'passage: ' || replace(text, 'e', 'E') || '</s>' AS passage FROM documents")
def prefix_template(spark, d):
    return docs(spark, d).select("doc_id", T.fill_template("passage: {text}</s>", text=F.replace("text", F.lit("e"), F.lit("E"))).alias("passage"))


@query("keep_columns", "SELECT doc_id, lang FROM documents")
def keep_columns(spark, d):
    wanted = {"lang", "doc_id", "label_ids"}
    df = docs(spark, d)
    return df.select(*[c for c in df.columns if c in wanted])


@query("drop_columns", "SELECT doc_id, source, n_chars FROM documents")
def drop_columns(spark, d):
    return docs(spark, d).drop("text", "lang")


@query("label_index", "SELECT c_custkey, list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) - 1 AS label FROM customer")
def label_index(spark, d):
    names = F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))
    place = F.array_position(names, F.col("c_mktsegment"))
    unknown = F.raise_error(F.concat(F.lit("unknown label "), F.col("c_mktsegment"))).cast("long")
    label = F.when(F.col("c_mktsegment").isNull(), F.lit(None).cast("long")).when(place > 0, place - 1).otherwise(unknown)
    return table(spark, d, "customer").select("c_custkey", label.cast("int").alias("label"))


@query("label_rename", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE o_orderstatus END AS label FROM orders")
def label_rename(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "finished").otherwise(F.col("o_orderstatus")).alias("label"))


@query("flatten_struct", "SELECT event_id, user_id AS \"who.id\", event_type AS \"what.type\", value AS \"what.value\" FROM events")
def flatten_struct(spark, d):
    nested = table(spark, d, "events").select("event_id", F.struct(F.col("user_id").alias("id")).alias("who"), F.struct(F.col("event_type").alias("type"), "value").alias("what"))
    return nested.select("event_id", *[F.col(f"{s}.{f}").alias(f"{s}.{f}") for s in ("who", "what") for f in nested.schema[s].dataType.names])


@query("cast_columns", "SELECT event_id, CAST(value AS INTEGER) AS value_int, CAST(user_id AS VARCHAR) AS user_text FROM (SELECT event_id, trunc(value) AS value, user_id FROM events)")
def cast_columns(spark, d):
    return table(spark, d, "events").select("event_id", F.col("value").cast("int").alias("value_int"), F.col("user_id").cast("string").alias("user_text"))


@query("choice_grid", "SELECT c_custkey, list(c_name || ' ' || e ORDER BY i) AS choices FROM (SELECT c_custkey, c_name, unnest(['a', 'b', 'c', 'd']) AS e, unnest([0, 1, 2, 3]) AS i FROM customer) GROUP BY 1")
def choice_grid(spark, d):
    """Each context with each of four endings, then grouped by four again."""
    ends = F.array(*map(F.lit, "abcd"))
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.posexplode(ends).alias("i", "e")).select("c_custkey", "i", F.concat_ws(" ", "c_name", "e").alias("x"))
    return rows.groupBy("c_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("choices"))


@query("arrays_to_structs", "SELECT l_orderkey, list(l_linenumber || ':' || CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_quantity) AS items FROM lineitem GROUP BY 1")
def arrays_to_structs(spark, d):
    """Parallel arrays to an array of structs, shown as text."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity")))).alias("r"))
    parallel = g.select("l_orderkey", F.col("r.line").alias("line"), F.col("r.quantity").alias("quantity"))
    return parallel.select("l_orderkey", F.transform(F.arrays_zip("line", "quantity"), lambda x: F.concat_ws(":", x["line"], x["quantity"].cast("bigint"))).alias("items"))


@query("label_pairs", "SELECT item_id, trim(l) AS label, text AS premise, 'This example is ' || trim(l) || '.' AS hypothesis FROM benchmark, (SELECT unnest(string_split('sport, law ,art', ',')) AS l)")
def label_pairs(spark, d):
    """Every sequence with every label of a short list; labels are an array constant, so nothing is joined."""
    labels = F.transform(F.split(F.lit("sport, law ,art"), ","), lambda x: F.btrim(x))
    return table(spark, d, "benchmark").select("item_id", F.explode(labels).alias("label"), F.col("text").alias("premise")).withColumn("hypothesis", F.concat(F.lit("This example is "), "label", F.lit(".")))


@query("duration_minutes", "SELECT event_id, CAST(round_even(epoch(ts) / 60.0 - floor(epoch(ts) / 3600.0) * 60, 0) AS BIGINT) AS minutes FROM events")
def duration_minutes(spark, d):
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").select("event_id", F.bround(s / 60.0 - F.floor(s / 3600.0) * 60, 0).cast("long").alias("minutes"))


@query("language_filter", "SELECT doc_id FROM documents WHERE lang = 'fr'")
def language_filter(spark, d):
    return docs(spark, d).where("lang = 'fr'").select("doc_id")


@query("length_budget", f"SELECT doc_id FROM documents WHERE len({_WORDS}) + length(source) < 512")
def length_budget(spark, d):
    return docs(spark, d).where(T.word_count(F.col("text")) + F.length("source") < 512).select("doc_id")


@query("group_size_filter", "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING count(*) BETWEEN 30 AND 55)")
def group_size_filter(spark, d):
    """A count joined back, not a window, so that a hot group is not one task's."""
    sized = docs(spark, d).groupBy("source").count().where("count BETWEEN 30 AND 55")
    return docs(spark, d).join(sized, "source", "left_semi").select("doc_id", "source")


@query("drop_by_ids", "SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def drop_by_ids(spark, d):
    return docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("score_threshold", "SELECT event_id, value FROM events WHERE value > 50")
def score_threshold(spark, d):
    return table(spark, d, "events").where("value > 50").select("event_id", "value")


@query("ignore_labels", "SELECT event_id FROM events WHERE event_type NOT IN ('view', 'click')")
def ignore_labels(spark, d):
    return table(spark, d, "events").where(~F.col("event_type").isin("view", "click")).select("event_id")


@query("keyword_lines", "SELECT DISTINCT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(line, 'icense')")
def keyword_lines(spark, d):
    return docs(spark, d).where(F.contains("text", F.lit("icense"))).select(F.explode(F.split("text", "\n")).alias("line")).where(F.contains("line", F.lit("icense"))).distinct()


@query(
    "age_filter",
    """WITH last AS (SELECT user_id, max(ts) AS seen, min(ts) AS first, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY 1)
SELECT user_id, kind FROM last WHERE date_diff('day', CAST(seen AS DATE), DATE '2024-02-07') > 7 AND date_diff('day', CAST(first AS DATE), DATE '2024-02-07') >= 30 AND kind NOT IN ('purchase')""",
)
def age_filter(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("seen"), F.min("ts").alias("first"), F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    day = F.lit("2024-02-07").cast("date")
    return last.where((F.datediff(day, "seen") > 7) & (F.datediff(day, "first") >= 30) & (F.col("kind") != "purchase")).select("user_id", "kind")


_SPLIT = "(SELECT item_id FROM benchmark)"


@query("split_by_ids", f"SELECT doc_id, CASE WHEN doc_id IN {_SPLIT} THEN 'dev' ELSE 'train' END AS split FROM documents")
def split_by_ids(spark, d):
    ids = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    dev = docs(spark, d).join(ids, "doc_id", "left_semi").select("doc_id", F.lit("dev").alias("split"))
    return dev.unionByName(docs(spark, d).join(ids, "doc_id", "left_anti").select("doc_id", F.lit("train").alias("split")))


_N = "(SELECT count(*) FROM documents)"
_ROW = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents"


@query("shard_last_rest", f"SELECT doc_id, CAST(least(r // ({_N} // 7), 6) AS INT) AS shard FROM ({_ROW})")
def shard_last_rest(spark, d):
    return row_id(spark, d).select("doc_id", O.shard_rest_to_last(F.col("row_id"), docs(spark, d).count(), 7).alias("shard"))


@query("shard_balanced", "SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) - 1 AS INT) AS shard FROM documents")
def shard_balanced(spark, d):
    return row_id(spark, d).select("doc_id", O.shard_balanced(F.col("row_id"), docs(spark, d).count(), 7).alias("shard"))


@query("round_robin", f"SELECT doc_id, CAST((r // 16) % 4 AS INT) AS worker, r // 1000 AS batch FROM ({_ROW})")
def round_robin(spark, d):
    return row_id(spark, d).select("doc_id", O.round_robin(F.col("row_id"), 16, 4).alias("worker"), O.batch_number(F.col("row_id"), 1000).alias("batch"))


@query("hash_split", "SELECT doc_id, CASE WHEN CAST('0x' || substring(md5('0-' || doc_id), 1, 8) AS BIGINT) % 10000 < 2000 THEN 'test' ELSE 'train' END AS split FROM documents")
def hash_split(spark, d):
    return docs(spark, d).select("doc_id", O.hash_split(F.col("doc_id")).alias("split"))


@query("first_n_split", f"SELECT doc_id, CASE WHEN r < 500 THEN 'train' ELSE 'rest' END AS split FROM ({_ROW})")
def first_n_split(spark, d):
    return row_id(spark, d).select("doc_id", F.when(F.col("row_id") < 500, "train").otherwise("rest").alias("split"))


@query("concat_sorted", "SELECT item_id AS id, text, 0 AS origin FROM benchmark UNION ALL SELECT doc_id, text, 1 FROM documents")
def concat_sorted(spark, d):
    return O.concatenated(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), docs(spark, d).select(F.col("doc_id").alias("id"), "text"))


@query("merge_workers", "SELECT event_id, CAST(event_id % 3 AS INT) AS rank FROM events")
def merge_workers(spark, d):
    e = table(spark, d, "events")
    return O.concatenated(*[e.where(F.pmod("event_id", F.lit(3)) == r).select("event_id") for r in range(3)], name="rank")


@query("label_union", "SELECT lang AS label FROM documents UNION SELECT event_type FROM events")
def label_union(spark, d):
    return docs(spark, d).select(F.col("lang").alias("label")).union(table(spark, d, "events").select("event_type")).distinct()


@query("jsonl_shard_no", f"SELECT doc_id, r AS id, r // 250 AS shard FROM ({_ROW})")
def jsonl_shard_no(spark, d):
    return row_id(spark, d).select("doc_id", F.col("row_id").alias("id"), O.batch_number(F.col("row_id"), 250).alias("shard"))


_GRAMS = " UNION ALL ".join(f"SELECT array_to_string(w[i : i + {n - 1}], ' ') AS ngram, {n} AS n FROM (SELECT w, unnest(range(1, len(w) - {n - 2})) AS i FROM t WHERE len(w) >= {n})" for n in range(2, 8))
_TOKENS = f"t AS (SELECT {_WORDS} AS w FROM benchmark)"


def _ngrams(df, most=None):
    return P.phrase_counts(df, T.tokens(F.col("text")), most)


@query("ngram_counts", f"WITH {_TOKENS} SELECT ngram, n, count(*) AS cnt FROM ({_GRAMS}) GROUP BY ALL")
def ngram_counts(spark, d):
    return _ngrams(table(spark, d, "benchmark"))


@query("top_vocab", f"WITH {_TOKENS} SELECT ngram, n, count(*) AS cnt FROM ({_GRAMS}) GROUP BY ALL ORDER BY cnt DESC, n, ngram LIMIT 200")
def top_vocab(spark, d):
    return _ngrams(table(spark, d, "benchmark"), 200).orderBy(F.col("cnt").desc(), "n", "ngram").limit(200)


_CORPUS = _TOKENS.replace("benchmark", "documents")


@query("corpus_ngram_counts", f"WITH {_CORPUS} SELECT ngram, n, count(*) AS cnt FROM ({_GRAMS}) GROUP BY ALL")
def corpus_ngram_counts(spark, d):
    """ngram_counts over the whole corpus, as phrase mining has it."""
    return _ngrams(docs(spark, d))


@query("corpus_top_vocab", f"WITH {_CORPUS} SELECT ngram, n, count(*) AS cnt FROM ({_GRAMS}) GROUP BY ALL ORDER BY cnt DESC, n, ngram LIMIT 200")
def corpus_top_vocab(spark, d):
    return _ngrams(docs(spark, d), 200).orderBy(F.col("cnt").desc(), "n", "ngram").limit(200)


@query("symbol_pairs", "SELECT p_partkey, list_distinct(list_transform(range(1, length(p_brand)), lambda i: p_brand[i] || ' ' || p_brand[i + 1])) AS n FROM part".replace("list_distinct(", "len(list_distinct(").replace(") AS n", ")) AS n"))
def symbol_pairs(spark, d):
    return table(spark, d, "part").select("p_partkey", F.size(T.symbol_pairs(F.split("p_brand", ""))).cast("long").alias("n"))


@query("char_diff", "SELECT DISTINCT c FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c NOT IN (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz ', ''))) AND c <> ''")
def char_diff(spark, d):
    """Distinct characters that a vocabulary lacks; each row is reduced before the shuffle."""
    known = F.array(*map(F.lit, "abcdefghijklmnopqrstuvwxyz "))
    return docs(spark, d).select(F.explode(F.array_except(F.array_distinct(F.split("text", "")), known)).alias("c")).where("c <> ''").distinct()


@query("distinct_counts", "SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, count(DISTINCT text) AS texts FROM documents")
def distinct_counts(spark, d):
    return docs(spark, d).agg(F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"), F.countDistinct("text").alias("texts"))


@query("blank_line_documents", "WITH l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10)) AS ls, unnest(range(1, len(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10))) + 1)) AS i FROM documents)) SELECT doc_id, part, count(*) AS n_lines FROM (SELECT doc_id, line, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM l) WHERE trim(line) <> '' GROUP BY ALL")
def blank_line_documents(spark, d):
    """A blank line begins a new document, within each source text."""
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split(F.replace("text", F.lit(". "), F.lit(".\n\n")), "\n")).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("part", F.sum((F.btrim("line") == "").cast("int")).over(w)).where(F.btrim("line") != "").groupBy("doc_id", "part").agg(F.count("*").alias("n_lines"))


_PAIRS = f"""w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
e AS (SELECT doc_id, unnest(list_concat(['< >'], w[1 : len(w) - 1])) AS a, unnest(w) AS b FROM w WHERE len(w) > 0),
c AS (SELECT a, b, count(*) AS n FROM e GROUP BY 1, 2),
k AS (SELECT CAST(count(*) FILTER (WHERE n = 1) AS DOUBLE) AS n1, count(*) FILTER (WHERE n = 2) AS n2, count(*) FILTER (WHERE n = 3) AS n3, count(*) FILTER (WHERE n = 4) AS n4, count(*) AS all_ FROM c),
y AS (SELECT *, n1 / (n1 + 2 * n2) AS y FROM k),
z AS (SELECT 1 - 2 * y * n2 / n1 AS d1, 2 - 3 * y * n3 / n2 AS d2, 3 - 4 * y * n4 / n3 AS d3, all_ FROM y),
d AS (SELECT a, b, n, CASE WHEN n = 1 THEN d1 WHEN n = 2 THEN d2 ELSE d3 END AS d, all_ FROM c, z),
p AS (SELECT a, b, (n - d) / sum(n) OVER (PARTITION BY a) + sum(d) OVER (PARTITION BY a) / sum(n) OVER (PARTITION BY a) * count(*) OVER (PARTITION BY b) / all_ AS p FROM d)"""


@query("corpus_perplexity", f"WITH {_PAIRS} SELECT doc_id, count(*) AS n_words, round(sum(-ln(p)), 4) AS nll, round(exp(sum(-ln(p)) / count(*)), 4) AS perplexity FROM e JOIN p USING (a, b) GROUP BY 1")
def corpus_perplexity(spark, d):
    """Every document by a smoothed model of all documents."""
    pairs = L.word_pairs(docs(spark, d), "doc_id", T.tokens(F.col("text")))
    scores = L.own_scores(pairs)
    return scores.select(F.col("id").alias("doc_id"), "n_words", F.round("nll", 4).alias("nll"), F.round("perplexity", 4).alias("perplexity"))
