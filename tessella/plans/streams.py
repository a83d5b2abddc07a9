"""Streaming queries, each replayed over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams as S
from .registry import query


def events(spark, d):
    """Event times as instants: the session's time zone is that of the table (UTC)."""
    return S.replay(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_tumbling", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    out = S.drained(S.tumbling(events(spark, d), "ts", "event_type", "value", "1 hour", "40 days"), mode="complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "stream_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM e)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, user_id, count(*) AS n FROM g GROUP BY user_id, k""",
)
def stream_sessions(spark, d):
    out = S.drained(S.sessions(events(spark, d), "ts", "user_id", "6 hours", "40 days"), mode="complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("stream_on_time", "SELECT event_id FROM events WHERE (user_id % 50) <= 30")
def stream_on_time(spark, d):
    e = events(spark, d).withColumn("arrival", F.timestamp_add("SECOND", F.pmod("user_id", F.lit(50)).cast("int"), F.col("ts")))
    return S.drained(S.on_time(e, "ts", "arrival", "3 seconds").select("event_id"))


@query("stream_words")
def stream_words(spark, d):
    """Conversations as streams of pieces of seven characters, given out in whole words."""
    c = S.replay(spark, f"{d}/conversations.parquet").withColumn("stream_id", F.concat_ws("-", "conv_id", "turn")).where("text IS NOT NULL")
    n = F.length("text")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / 7), F.lit(0)).cast("int")), lambda i: F.struct(i.alias("seq"), F.substring("text", i * 7 + 1, F.lit(7)).alias("piece"), (i == F.floor((n - 1) / 7)).alias("is_last")))
    return S.drained(S.emit_words(c.select("stream_id", F.explode(parts).alias("p")).select("stream_id", "p.*")))


@query("stream_chunks")
def stream_chunks(spark, d):
    """Benchmark texts as streams of pieces of 50 bytes, given out as chunks of 120 that overlap by 10 on either side."""
    b = S.replay(spark, f"{d}/benchmark.parquet").where("text IS NOT NULL").withColumn("data", F.encode("text", "UTF-8"))
    n = F.length("data")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / 50), F.lit(0)).cast("int")), lambda i: F.struct(i.alias("seq"), F.substring("data", i * 50 + 1, F.lit(50)).alias("piece"), (i == F.floor((n - 1) / 50)).alias("is_last")))
    return S.drained(S.emit_chunks(b.select(F.col("item_id").alias("stream_id"), F.explode(parts).alias("p")).select("stream_id", "p.*"), 120, 10, 10))


@query("stream_dedup", "SELECT user_id, min(event_id) IS NOT NULL AS seen FROM events GROUP BY 1")
def stream_dedup(spark, d):
    return S.drained(events(spark, d).dropDuplicates(["user_id"]).select("user_id", F.col("event_id").isNotNull().alias("seen")))


@query("stream_interval_join", "SELECT c.event_id, p.event_id AS right_event_id, c.user_id FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 6 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase'")
def stream_interval_join(spark, d):
    """Purchases within six hours of a click, as two streams joined."""
    side = lambda kind: events(spark, d).where(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    joined = S.interval_join(side("click"), side("purchase"), "user_id", "ts", "6 hours", "40 days")
    return S.drained(joined.select("event_id", "right_event_id", "user_id"))
