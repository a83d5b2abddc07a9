"""Chat formatting: multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all
others as named users; only the assistant's words and the mark that ends them are trained on. The
result has one row for each conversation, perspective and message, with character offsets into the rendered dialogue, so no
conversation is ever gathered into one row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns whose offsets are summed in one window; blocks of turns are summed first.
BLOCK_TURNS = 256
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Conversations with more than one message in so many are hot: no more than this many, dealt over SALTS tasks each.
HOT, SALTS = 4096, 64


def _unmarked(text: Column) -> Column:
    """Text whose marks are broken by a space, so that it can neither end a turn nor begin one."""
    for mark in (OPEN, CLOSE.strip()):
        text = F.replace(text, F.lit(mark), F.lit("< " + mark[1:]))
    return text


def _one_line(name: Column) -> Column:
    """A name as it may stand in a turn's first line: without marks, and a run of control characters is one space."""
    return _unmarked(F.regexp_replace(name, r"[\x00-\x1F\x7F]+", " "))


def _salted(said: DataFrame, people: DataFrame) -> DataFrame:
    """Every message with every participant of its conversation; hot conversations are dealt over several tasks."""
    total = said.count()
    counts = said.groupBy("_conv").count().where(F.col("count") > total // HOT).select(F.col("_conv").alias("_key"), F.lit(True).alias("_is_hot"))
    hot = F.broadcast(counts.where("_key is not null"))  # at most HOT rows
    salt = F.when(F.col("_is_hot"), F.pmod(F.xxhash64("_turn", "_content"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.explode(F.when(F.col("_is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    left = said.join(hot, F.col("_conv") == F.col("_key"), "left").withColumn("_salt", salt).drop("_key", "_is_hot")
    right = people.join(hot, F.col("_of") == F.col("_key"), "left").select("_of", "_view", salts.alias("_with"))
    return left.join(right, F.col("_conv").eqNullSafe(F.col("_of")) & (F.col("_salt") == F.col("_with"))).drop("_salt", "_with")


def rotate_perspectives(conversations: DataFrame, speaker_col: str = "role") -> DataFrame:
    """conv_id, perspective, turn, role, name, content, segment, start, end, mask_start, mask_end.

    Segments in order of `start` are the dialogue; characters from mask_start to mask_end are trained on (null: none).
    Participants are all speakers but the system, whose messages keep their role. A null speaker takes part as "unknown", a null
    text is empty, a null turn comes first, messages of one turn go by speaker and text, repeated messages stay; a null
    conv_id is a conversation of its own. A conversation of system messages only has no perspective. A mark inside a
    message or a name is broken by a space, and control characters of a name are spaces in the turn's first line, so that neither can
    end a turn or begin one; `name` is the speaker as given. Texts of any length stay whole. Other columns are ignored; no rows give no rows.
    """
    content = _unmarked(F.coalesce("text", F.lit("")))
    said = conversations.select(
        F.col("conv_id").alias("_conv"), F.col("turn").cast("long").alias("_turn"), F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("_speaker"), content.alias("_content")
    ).withColumn("_block", F.floor(F.col("_turn") / BLOCK_TURNS))
    people = said.where(F.col("_speaker") != SYSTEM).select(F.col("_conv").alias("_of"), F.col("_speaker").alias("_view")).distinct()
    seen = _salted(said, people)
    role = F.when(F.col("_speaker") == SYSTEM, F.lit(SYSTEM)).when(F.col("_speaker") == F.col("_view"), F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when(role == "user", F.col("_speaker"))
    head = F.concat(F.lit(OPEN), role, F.when(name.isNotNull(), F.concat(F.lit(" name="), _one_line(name))).otherwise(F.lit("")), F.lit("\n"))
    seen = seen.withColumn("_head", F.length(head)).withColumn("_segment", F.concat(head, F.col("_content"), F.lit(CLOSE))).withColumn("_role", role).withColumn("_name", name)
    seen = seen.withColumn("_length", F.length("_segment"))
    view = ["_conv", "_view"]
    blocks = seen.groupBy(*view, "_block").agg(F.sum("_length").alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(*view).orderBy(F.col("_block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(F.col("_conv").alias("_c"), F.col("_view").alias("_v"), F.col("_block").alias("_b"), F.coalesce(earlier, F.lit(0)).alias("_before"))
    order = Window.partitionBy(*view, "_block").orderBy(F.col("_turn").asc_nulls_first(), "_speaker", "_content").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = seen.withColumn("_within", F.sum("_length").over(order) - F.col("_length"))
    same = F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_view") == F.col("_v")) & F.col("_block").eqNullSafe(F.col("_b"))
    placed = placed.join(blocks, same).withColumn("_start", F.col("_before") + F.col("_within"))
    own = F.col("_role") == "assistant"
    return placed.select(
        F.col("_conv").alias("conv_id"),
        F.col("_view").alias("perspective"),
        F.col("_turn").alias("turn"),
        F.col("_role").alias("role"),
        F.col("_name").alias("name"),
        F.col("_content").alias("content"),
        F.col("_segment").alias("segment"),
        F.col("_start").alias("start"),
        (F.col("_start") + F.col("_length")).alias("end"),
        F.when(own, F.col("_start") + F.col("_head")).alias("mask_start"),
        F.when(own, F.col("_start") + F.col("_length") - 1).alias("mask_end"),  # without the newline after the mark
    )


SQL = r"""
WITH s AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker,
  replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS content FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM s WHERE speaker <> 'system'),
r AS (SELECT s.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.c),
h AS (SELECT *, CASE WHEN role = 'user' THEN speaker END AS name, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || replace(replace(regexp_replace(speaker, '[\x00-\x1F\x7F]+', ' ', 'g'), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') ELSE '' END || chr(10) AS head FROM r),
g AS (SELECT *, head || content || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS "end" FROM g)
SELECT conv_id, perspective, turn, role, name, content, segment, "end" - length(segment) AS start, "end",
  CASE WHEN role = 'assistant' THEN "end" - length(segment) + length(head) END AS mask_start,
  CASE WHEN role = 'assistant' THEN "end" - 1 END AS mask_end FROM o"""
