"""Mixing sources to target weights by hierarchical budgeting.

The token budget goes down a tree of domain, language and source by the weights of each node's children. A
child never gets more than its subtree can give (its tokens times the epochs allowed); what it leaves is
shared by its siblings, by weight, and only what a whole group of siblings leaves reaches the group above. Each leaf then gives
full epochs and a token-prefix of the next, in an order seeded by epoch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import ROW, keyed, stored

LEVELS = ["domain", "lang", "source"]
WORD = r"[^ \t\n\x0B\f\r]+"
#: Documents of a leaf whose running sum one window makes.
BUCKET_DOCS = 4096


@dataclass(frozen=True)
class Mixture:
    """Relative weights by node name at each level (others: `other`), the share of all tokens to draw, epochs at most, seed. A weight
    of 0 leaves a node out: its siblings share what it would have had. Negative weights are a ValueError."""

    domain: dict[str, float] = field(default_factory=lambda: {"d0": 4.0, "d1": 3.0, "d2": 2.0})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 5.0, "de": 2.0, "fr": 2.0})
    source: dict[str, float] = field(default_factory=dict)
    other: float = 1.0
    share: float = 0.5
    epochs: int = 3
    seed: int = 42

    def __post_init__(self):
        if any(not w >= 0 for w in [self.other, *self.domain.values(), *self.lang.values(), *self.source.values()]):
            raise ValueError("weights are 0 or more")


def domain_of(source: str = "source") -> Column:
    """Sources in domains of five by their number: a stand-in where a corpus names no domain."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})$", 1)
    return F.concat(F.lit("d"), F.when(number == "", F.lit("x")).otherwise(F.floor(number.cast("long") / 5).cast("string")))


def _weight(mix: Mixture, level: str) -> Column:
    known = getattr(mix, level)
    if not known:
        return F.lit(mix.other)
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(table[F.col(level)], F.lit(mix.other))


def _filled(children: DataFrame, group: list[str], most: Column, node: list[str]) -> DataFrame:
    """Budget of each child: weight times one level for the group, or all it has; the level uses `most` up.

    The total min(cap, weight * level) is the least over k of what the k children that run out first have
    plus level times the weight of the others, so the level is the largest of the levels that these give.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    order = w.orderBy(F.try_divide("cap", "weight"), *node).rowsBetween(Window.unboundedPreceding, -1)  # nodes of weight 0, and so a cap of 0, come first
    before, heavy = F.coalesce(F.sum("cap").over(order), F.lit(0)), F.sum("weight").over(w) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    stepped = children.withColumn("most", F.least(most, F.sum("cap").over(w))).withColumn("step", F.try_divide(F.col("most") - before, heavy))
    level = F.max("step").over(w)
    return stepped.withColumn("budget", F.least(F.col("cap").cast("double"), F.col("weight") * level)).drop("most", "step")


def leaf_budgets(counted: DataFrame, mix: Mixture) -> DataFrame:
    """domain, lang, source, docs, tokens, budget of every leaf. counted: a row for each document with its n."""
    leaves = counted.groupBy(*LEVELS).agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))
    leaves = stored(leaves.where("tokens > 0").withColumn("cap", F.when(F.least(*[_weight(mix, k) for k in LEVELS]) > 0, F.col("tokens") * mix.epochs).otherwise(0)), "mixing-leaves")
    total = F.lit(float((leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]) * mix.share))
    budget = None
    for k in range(1, 4):
        node, group = LEVELS[:k], LEVELS[: k - 1]
        children = leaves.groupBy(*node).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(mix, LEVELS[k - 1]))
        if budget is not None:
            children = children.join(budget.withColumnRenamed("budget", "given"), group)
        budget = _filled(children, group, F.col("given") if group else total, node).select(*node, "budget")
    return leaves.join(budget, LEVELS).select(*LEVELS, "docs", "tokens", F.floor(F.round(F.col("budget"), 3)).cast("long").alias("budget"))


def _order_key(mix: Mixture, epoch: Column) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def mix_sources(docs: DataFrame, mix: Mixture = Mixture(), domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epochs, take_tokens: one row for each document row.

    Tokens are words between ASCII white space. A document is taken whole `epochs` times, and take_tokens is the number of
    its tokens in all: more than epochs * n_tokens where the leaf's token-prefix reaches or ends in it. Null or
    empty texts have no tokens and are taken 0 times. A null domain, language or source is the node "none". Rows that repeat a doc_id count each; they stand
    together in the order, so a prefix that ends there may cut any one of them. Other columns are ignored; no rows give no rows.
    """
    return _taken(docs, mix, domain, id_col, text_col, [])


def _taken(docs: DataFrame, mix: Mixture, domain: Column | None, id_col: str, text_col: str, keys: list[str]) -> DataFrame:
    none = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    named = docs.select(
        *keys,
        F.col(id_col).alias("doc_id"),
        none(domain_of() if domain is None else domain).alias("domain"),
        none(F.col("lang")).alias("lang"),
        none(F.col("source")).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("n"),
    )
    counted = stored(named, "mixing-counts")
    leaves = leaf_budgets(counted, mix).withColumn("full", F.floor(F.col("budget") / F.col("tokens"))).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))
    placed = counted.join(leaves, LEVELS, "left").withColumn("key", _order_key(mix, F.col("full")))
    # Running sums of a leaf by buckets of the order key: first the buckets, then the cells of each. A cell has the rows of one key
    # and length that one stored partition holds, so that rows which repeat an id, and so share a key, are never one window.
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    placed = placed.withColumn("bucket", F.floor(place * F.ceil(F.coalesce("docs", F.lit(1)) / BUCKET_DOCS))).withColumn("part", F.spark_partition_id())
    placed = stored(placed, "mixing-placed")
    sums = placed.groupBy(*LEVELS, "bucket").agg(F.sum("n").alias("sum"))
    ahead = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*LEVELS, "bucket", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("ahead"))
    cell = [*LEVELS, "bucket", "key", "n", "part"]
    cells = placed.groupBy(*cell).agg((F.count("*") * F.col("n")).alias("held"))
    within = Window.partitionBy(*LEVELS, "bucket").orderBy("key", "n", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("within", F.sum("held").over(within) - F.col("held")).join(sums, [*LEVELS, "bucket"]).select(*cell, (F.col("ahead") + F.col("within")).alias("before"))
    nth = F.row_number().over(Window.partitionBy(*cell).orderBy(*(keys or ["doc_id"]))) - 1
    at = placed.join(cells, cell).withColumn("nth", nth)
    prefix = F.greatest(F.lit(0), F.least(F.col("n"), F.col("rest") - F.col("before") - F.col("n") * F.col("nth")))
    epochs = F.coalesce("full", F.lit(0)) + F.when((F.col("n") > 0) & (prefix == F.col("n")), 1).otherwise(0)
    take = F.coalesce(F.col("full") * F.col("n") + prefix, F.lit(0))
    return at.select(*keys, "doc_id", *LEVELS, F.col("n").alias("n_tokens"), F.when(F.col("n") > 0, epochs).otherwise(0).cast("long").alias("epochs"), take.cast("long").alias("take_tokens"))


def mixed_documents(docs: DataFrame, mix: Mixture = Mixture(), domain: Column | None = None) -> DataFrame:
    """The columns of docs: each document once for every epoch that takes it, and the one that a leaf's prefix
    cuts, once more, with as many of its words as the prefix has, joined by spaces.

    Every row is mixed by itself, also where its id is null or repeated.
    """
    keys = keyed(docs)
    taken = _taken(keys, mix, domain, "doc_id", "text", [ROW]).where("take_tokens > 0").select(ROW, F.col("epochs").alias("_epochs"), (F.col("take_tokens") - F.col("epochs") * F.col("n_tokens")).alias("_cut"))
    rows = keys.join(taken, ROW)
    copies = F.concat(F.when(F.col("_epochs") > 0, F.array_repeat(F.lit(0).cast("long"), F.col("_epochs").cast("int"))).otherwise(F.array().cast("array<long>")), F.when(F.col("_cut") > 0, F.array("_cut")).otherwise(F.array().cast("array<long>")))
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("_words").cast("int")), " ")
    out = rows.withColumn("_words", F.explode(copies)).withColumn("text", F.when(F.col("_words") > 0, words).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def oracle(mix: Mixture = Mixture()) -> str:
    """The same in DuckDB SQL, leaves without tokens included."""

    def weight(level: str) -> str:
        known = getattr(mix, level)
        return f"CASE {' '.join(f"WHEN {level} = '{k}' THEN {float(v)}" for k, v in known.items())} ELSE {mix.other} END" if known else f"CAST({mix.other} AS DOUBLE)"

    def filled(k: int) -> str:
        node, group = ", ".join(LEVELS[:k]), ", ".join(LEVELS[: k - 1]) or "1"
        given = f"JOIN b{k - 1} USING ({', '.join(LEVELS[: k - 1])})" if k > 1 else f"CROSS JOIN (SELECT sum(tokens) * {mix.share} AS budget FROM leaf)"
        return f"""
c{k} AS (SELECT c.*, least(budget, sum(cap) OVER (PARTITION BY {group})) AS most FROM (SELECT {node}, sum(cap) AS cap, {weight(LEVELS[k - 1])} AS weight FROM leaf GROUP BY {node}) c {given}),
s{k} AS (SELECT *, (most - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER (PARTITION BY {group}) - coalesce(sum(weight) OVER o, 0)) AS step FROM c{k}
  WINDOW o AS (PARTITION BY {group} ORDER BY cap / weight, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b{k} AS (SELECT {node}, least(CAST(cap AS DOUBLE), weight * max(step) OVER (PARTITION BY {group})) AS budget FROM s{k})"""

    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS n,
  'd' || CASE WHEN regexp_extract(coalesce(source, ''), '(\\d{{1,9}})$', 1) = '' THEN 'x' ELSE CAST(CAST(regexp_extract(source, '(\\d{{1,9}})$', 1) AS BIGINT) // 5 AS VARCHAR) END AS domain FROM documents),
leaf AS (SELECT domain, lang, source, sum(n) AS tokens, sum(n) * {mix.epochs} AS cap FROM d GROUP BY ALL HAVING sum(n) > 0),{filled(1)},{filled(2)},{filled(3)},
l AS (SELECT domain, lang, source, CAST(floor(round(budget, 3)) AS BIGINT) // CAST(tokens AS BIGINT) AS whole, CAST(floor(round(budget, 3)) AS BIGINT) % CAST(tokens AS BIGINT) AS rest FROM leaf JOIN b3 USING (domain, lang, source)),
p AS (SELECT d.*, whole, rest, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5('{mix.seed}-' || whole || '-' || doc_id), n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before
  FROM d LEFT JOIN l USING (domain, lang, source)),
t AS (SELECT *, greatest(0, least(n, rest - before)) AS prefix FROM p)
SELECT doc_id, domain, lang, source, n AS n_tokens, CAST(CASE WHEN n > 0 THEN whole + CASE WHEN prefix = n THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS epochs,
  CAST(coalesce(whole * n + prefix, 0) AS BIGINT) AS take_tokens FROM t"""
