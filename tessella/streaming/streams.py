"""Streams: replay of tables, word-complete text, overlapping chunks, windows over event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import CHINESE
from ..operators.storage import new_path


def replay(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream. The last letter is a pattern, so that one file is as good as a folder."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def drained(stream: DataFrame, mode: str = "append", batch: Callable[[DataFrame, int], DataFrame] | None = None, state_rows: list[int] | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote, from the folder that all machines share.

    Results are files keyed by batch: a batch that runs again overwrites its own. state_rows takes the rows that the state
    held after each batch.
    """
    spark = stream.sparkSession
    root = new_path(spark, "stream")

    def put(df: DataFrame, n: int) -> None:
        (batch(df, n) if batch else df).write.mode("overwrite").parquet(f"{root}/out/batch={n}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    if state_rows is not None:
        state_rows += [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress]
    out = spark.read.schema(stream.schema).option("basePath", f"{root}/out").parquet(f"{root}/out")
    return out.select(*stream.columns)


def interval_join(left: DataFrame, right: DataFrame, key: str, ts: str, within: str, late: str) -> DataFrame:
    """Columns of left, and those of right with the prefix right_, of rows with the same key where right is no earlier than left and at most `within`
    later. Both sides are streams with a watermark of `late`: rows that are too late are left out, and the state forgets what no row on
    time can meet any more."""
    marked = left.withWatermark(ts, late)
    other = right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns]).withWatermark(f"right_{ts}", late)
    near = (F.col(f"right_{ts}") >= F.col(ts)) & (F.col(f"right_{ts}") <= F.col(ts) + F.expr(f"interval {within}"))
    return marked.join(other, (F.col(key) == F.col(f"right_{key}")) & near)


def tumbling(events: DataFrame, ts: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """window_start, key, n, total of event-time windows; rows later than the watermark are left out."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), key, "n")


def on_time(events: DataFrame, event_time: str, arrival: str, delta: str, times: int = 10) -> DataFrame:
    """Rows that arrived no later than `times` deltas after they were due. Processing-time lateness as a predicate."""
    return events.where(F.col(arrival) <= F.col(event_time) + F.expr(f"interval {delta}") * times)


# ---------------------------------------------------------------- words


def word_flush(buffer: str, piece: str, end: bool = False) -> tuple[str, str]:
    """What can be shown of a growing text, and what is kept back: all up to a line break or a Chinese
    character at the end, else up to the last space; everything at the end."""
    text = buffer + piece
    if end or text.endswith("\n") or (text and _chinese(text[-1])):
        return text, ""
    cut = text.rfind(" ") + 1
    return text[:cut], text[cut:]


_CHINESE = [(chr(int(a, 16)), chr(int(b, 16))) for a, b in CHINESE]
_FIRST_CHINESE = min(_CHINESE)[0]


def _chinese(c: str) -> bool:
    return c >= _FIRST_CHINESE and any(a <= c <= b for a, b in _CHINESE)


def _ordered(parts: list[pd.DataFrame], order: str) -> pd.DataFrame:
    """Rows of one key by `order`. Most keys come as one frame that is sorted already, and a table has very many keys."""
    rows = parts[0] if len(parts) == 1 else pd.concat(parts)
    return rows if rows[order].is_monotonic_increasing else rows.sort_values(order)


def emit_words(pieces: DataFrame, key: str = "stream_id", order: str = "seq", piece: str = "piece", last: str = "is_last") -> DataFrame:
    """key, seq, shown: a stream of text pieces to whole words. The state of a key is the text kept back, so it is
    as long as a word. Pieces of a key come in order of batches, and of `order` within one."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (kept,) = state.get if state.exists else ("",)
        rows = _ordered(list(parts), order)
        seqs, texts, done = [], [], False
        for seq, text, end in zip(rows[order].tolist(), rows[piece].tolist(), rows[last].tolist()):
            done = bool(end)
            shown, kept = word_flush(kept, text or "", done)
            if shown:
                seqs.append(seq)
                texts.append(shown)
        if not done:
            state.update((kept,))
        elif state.exists:
            state.remove()
        if texts:
            yield pd.DataFrame({key: [k[0]] * len(texts), order: seqs, "shown": texts})

    kind = dict(pieces.dtypes)
    return pieces.groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, {order} {kind[order]}, shown string", "kept string", "append", GroupStateTimeout.NoTimeout)


def chunk_stream(buffer: bytes, data: bytes, length: int, left: int, right: int, started: bool, end: bool) -> tuple[list[tuple[bytes, int, int]], bytes, bool]:
    """Overlapping chunks (bytes, left stride, right stride) of a growing byte string, what is kept, and whether
    one has been given. The rest at the end is a chunk if it is longer than the left stride."""
    if left + right >= length:
        raise ValueError("strides must be shorter than a chunk together")
    acc, out = buffer + data, []
    while len(acc) >= length:
        out.append((acc[:length], left if started else 0, right))
        started, acc = True, acc[length - left - right :]
    if end and len(acc) > left:
        out.append((acc, left if started else 0, 0))
    return out, b"" if end else acc, started


def emit_chunks(pieces: DataFrame, length: int, left: int, right: int, key: str = "stream_id", order: str = "seq", piece: str = "piece", last: str = "is_last") -> DataFrame:
    """key, chunk_no, chunk, left, right: a stream of byte pieces to overlapping chunks; the state is shorter than a chunk."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, n = state.get if state.exists else (b"", 0)
        rows, out = _ordered(list(parts), order), []
        for data, end in zip(rows[piece], rows[last]):
            chunks, kept, _ = chunk_stream(bytes(kept), bytes(data or b""), length, left, right, n > 0, bool(end))
            for c in chunks:
                out.append((k[0], n, *c))
                n += 1
            if end:
                kept, n = b"", 0
        state.update((kept, n))
        yield pd.DataFrame(out, columns=[key, "chunk_no", "chunk", "left", "right"])

    kind = dict(pieces.dtypes)
    return pieces.groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, chunk_no int, chunk binary, left int, right int", "kept binary, n int", "append", GroupStateTimeout.NoTimeout)


def timestamp_rules(logits: list[float], history: list[int], first: int, end: int, most_initial: int | None = None) -> list[float]:
    """Scores with timestamps (ids from `first` on) kept in pairs and in order: after one pair text follows, after a lone
    timestamp another or the end; the first is at most most_initial steps in; and only timestamps remain where they are together
    likelier than any text."""
    import numpy as np

    x = np.array(logits, float)
    stamp = [t >= first for t in history]
    one = bool(stamp and stamp[-1])
    two = len(stamp) < 2 or stamp[-2]
    if one and two:
        x[first:] = -np.inf
    elif one:
        x[:end] = -np.inf
    if not history:
        x[:first] = -np.inf
        if most_initial is not None:
            x[first + most_initial + 1 :] = -np.inf
    p = x - np.log(np.exp(x - x.max()).sum()) - x.max()
    stamps = np.logaddexp.reduce(p[first:]) if np.isfinite(p[first:]).any() else -np.inf
    if stamps > p[:first].max():
        x[:first] = -np.inf
    return x.tolist()


def flat_map_then_regroup(rows: DataFrame, key: str, parts: Column, total: Callable[[Column], Column]) -> DataFrame:
    """One row to several and back: key and an aggregate over its parts."""
    return rows.select(key, F.explode(parts).alias("part")).groupBy(key).agg(total(F.col("part")).alias("total"))
