"""Operators called from SQL, and ordered folds."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import sql
from ..operators.sequences import folded
from . import scoring  # noqa: F401  its SQL is used here
from .registry import SQL, query, table

_W = "list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')"


def _run(spark, d, text):
    """SQL over the given tables, by their names in braces."""
    sql.register(spark)
    return spark.sql(text, **{n: table(spark, d, n) for n in ("documents", "events") if "{" + n + "}" in text})


@query(
    "sql_chunks",
    f"""SELECT doc_id, CAST(k // 32 AS INT) AS chunk, CAST(len(ws[k + 1 : k + 64]) AS INT) AS n_words, array_to_string(ws[k + 1 : k + 64], ' ') AS chunk_text FROM (
SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 64, 0) + 32, 32)) AS k FROM (SELECT doc_id, {_W} AS ws FROM documents) WHERE len(ws) > 0) WHERE k = 0 OR k - 32 + 64 < len(ws)""",
)
def sql_chunks(spark, d):
    return _run(spark, d, "SELECT * FROM tessella_chunks(TABLE(SELECT doc_id, text FROM {documents}), 'text', 64, 32)")


@query(
    "sql_runs",
    """WITH e AS (SELECT user_id, event_type, row_number() OVER w - 1 AS k, row_number() OVER w - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id AS run_key, event_type AS item, min(k) AS place, count(*) AS length FROM e GROUP BY user_id, event_type, g""",
)
def sql_runs(spark, d):
    return _run(spark, d, "SELECT * FROM tessella_runs(TABLE(SELECT user_id, event_type, ts, event_id FROM {events}) PARTITION BY user_id ORDER BY (ts, event_id), 'user_id', 'event_type')")


@query("sql_text_functions", f"SELECT doc_id, CAST(len({_W}) AS INT) AS n_words, normalized FROM documents JOIN ({SQL['normalize_answer']}) USING (doc_id)")
def sql_text_functions(spark, d):
    return _run(spark, d, "SELECT doc_id, tessella_word_count(text) AS n_words, tessella_normalize_answer(text) AS normalized FROM {documents}")


@query(
    "sequential_answers",
    """WITH RECURSIVE c AS (SELECT conv_id, turn, (length(coalesce(text, '')) * 7 % 11 - 5) / 4.0 AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations),
r AS (SELECT conv_id, turn, k, false AS previous, 1 / (1 + exp(0.6 - x)) AS p FROM c WHERE k = 1
UNION ALL SELECT c.conv_id, c.turn, c.k, r.p > 0.5, 1 / (1 + exp((CASE WHEN r.p > 0.5 THEN -0.6 ELSE 0.6 END) - c.x)) FROM r JOIN c ON c.conv_id = r.conv_id AND c.k = r.k + 1)
SELECT conv_id, turn, previous, round(p, 6) AS probability, p > 0.5 AS answer FROM r""",
)
def sequential_answers(spark, d):
    """Questions of a conversation in turn, each with the answer before it as a part of its input."""

    def step(previous: bool, row: dict) -> tuple[bool, tuple]:
        x = (len(row["text"] or "") * 7 % 11 - 5) / 4.0 + (0.6 if previous else -0.6)
        p = 1 / (1 + math.exp(-x))
        return p > 0.5, (row["conv_id"], row["turn"], previous, p, p > 0.5)

    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    out = folded(turns, ["conv_id"], ["turn", "role", "text"], step, False, "conv_id long, turn long, previous boolean, probability double, answer boolean")
    return out.withColumn("probability", F.round("probability", 6))
