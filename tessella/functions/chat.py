"""Conversations: message rules and prompt rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("user", "assistant", "system")


def valid_messages(rows: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages with a known role and a text, without a user's turn right after another user's."""
    known = rows.where(F.col(role).isin(*ROLES) & F.col(text).isNotNull())
    before = F.lag(role).over(Window.partitionBy(conv).orderBy(order))
    return known.withColumn("_before", before).where(~((F.col(role) == "user") & F.coalesce(F.col("_before") == "user", F.lit(False)))).drop("_before")


def conversations(rows: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, messages: an array of (role, content) in order. A conversation is one row: its length bounds the row."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return rows.groupBy(conv).agg(F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def render_concatenated(messages: Column, end: str = "<|endoftext|>") -> Column:
    """Every content followed by the end mark."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["content"], F.lit(end))), "")


def alternates(messages: Column) -> Column:
    """Whether, after a first system message, users and others take turns, a user first."""
    body = F.when(F.element_at(messages, 1)["role"] == "system", F.slice(messages, F.lit(2), F.size(messages))).otherwise(messages)
    return F.forall(F.transform(body, lambda m, i: (m["role"] == "user") == (i % 2 == 0)), lambda x: x)


def render_instructions(messages: Column, begin: str = "<s>", end: str = "</s>", strict: bool = False) -> Column:
    """[INST] prompts: the first system message inside the first user's, others between system marks; null
    where the roles don't alternate, or an error if strict."""
    first = F.element_at(messages, 1)
    has_system = first["role"] == "system"
    body = F.when(has_system, F.slice(messages, F.lit(2), F.size(messages))).otherwise(messages)

    def one(m: Column, i: Column) -> Column:
        content = F.when(has_system & (i == 0), F.concat(F.lit("<<SYS>>\n"), first["content"], F.lit("\n<</SYS>>\n\n"), m["content"])).otherwise(m["content"])
        plain = F.regexp_replace(content, r"^\s+|\s+$", "")
        return F.when(m["role"] == "user", F.concat(F.lit(begin + "[INST] "), plain, F.lit(" [/INST]"))).when(m["role"] == "system", F.concat(F.lit("<<SYS>>\n"), plain, F.lit("\n<</SYS>>\n\n"))).otherwise(F.concat(F.lit(" "), plain, F.lit(" " + end)))

    bad = F.raise_error(F.lit("conversation roles must alternate user/assistant")).cast("string") if strict else F.lit(None).cast("string")
    return F.when(alternates(messages), F.array_join(F.transform(body, one), "")).otherwise(bad)


def views(messages: Column) -> Column:
    """Struct past_user_inputs, generated_responses: texts by role; a last user's turn that has no answer yet is left out."""
    of = lambda role: F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: m["content"])
    users = of("user")
    open_ = F.element_at(messages, -1)["role"] == "user"
    return F.struct(F.when(open_, F.slice(users, F.lit(1), F.size(users) - 1)).otherwise(users).alias("past_user_inputs"), of("assistant").alias("generated_responses"))
