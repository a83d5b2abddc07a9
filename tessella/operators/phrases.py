"""Runs of words, counted in Spark over sorted rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.procedural import STEP_WORDS, text_slices
from .storage import stored

#: Words of the shortest and the longest run.
SHORT, LONG = 2, 7
#: First words that begin more than one in HOT runs of the corpus are counted apart.
HOT = 4096
#: Where words are compared, bytes are one higher, so that the end of a word comes before all that a word may hold: rows with the same first words lie
#: together. No text in UTF-8 has the byte 255.
_UP = np.arange(1, 257).astype(np.uint8)
_UP[ord(" ")] = 0
_DOWN = np.arange(-1, 255).astype(np.uint8)
_DOWN[0] = ord(" ")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and where its rows begin and end in them."""
    width = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    at = np.frombuffer(column.buffers()[1], width, len(column) + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]) if data is not None else np.zeros(0, np.uint8), at - at[0]


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Pieces of data from start to end, one value each."""
    size = end - start
    upto = np.concatenate([[0], np.cumsum(size)])
    made = data[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])]
    return pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(made)])


def _places(hot: list[bytes], often: bool):
    """head, tail of each place where a run begins: its first two words, and up to five more; of places with a hot head, or of all others."""

    def made(data, first, end, last, word) -> pa.RecordBatch:
        head = _cut(data, first[word], end[word + SHORT - 1], pa.binary())
        if hot:
            taken = pc.is_in(head, pa.array(hot, pa.binary()))
            taken = (taken if often else pc.invert(taken)).to_numpy(zero_copy_only=False)
            head, word = head.filter(pa.array(taken)), word[taken]
        tail = _cut(data, end[word + SHORT - 1], end[np.minimum(word + LONG - 1, last[word])], pa.binary())
        return pa.record_batch([head, tail], ["head", "tail"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_slices(batch.column(0)):
                data, at = _bytes(texts)
                spaces, held = np.flatnonzero(data == ord(" ")), np.diff(at) > 0
                first = np.sort(np.concatenate([at[:-1][held], spaces + 1]))
                end = np.sort(np.concatenate([at[1:][held], spaces]))
                last = np.searchsorted(first, at[1:]) - 1  # the last word of each text
                last = np.repeat(last[held], np.diff(np.concatenate([[-1], last[held]])))
                word = np.flatnonzero(np.arange(len(first)) < last)
                data = _UP[data]
                for k in range(0, len(word), STEP_WORDS):
                    yield made(data, first, end, last, word[k : k + STEP_WORDS])

    return cut


def _runs(most: int | None):
    """ngram, n, cnt of the runs that begin rows sorted by head and tail. Rows with the same first words lie together, so all lengths are counted in
    one pass, each row against the one before it; the runs of the last row are carried to the next batch. With `most`, counts below the `most`
    greatest that the task has met are left out."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, carried = None, None  # the last row, and how often its beginnings of each length were met
        best = np.zeros(0, np.int64)

        def given(text: list, n: list, cnt: list) -> pa.RecordBatch:
            nonlocal best
            text, n, cnt = pa.concat_arrays(text), np.concatenate(n), np.concatenate(cnt)
            if most:
                best = np.sort(np.concatenate([best, cnt]))[-most:]
            return pa.record_batch([text, pa.array(n, pa.int32()), pa.array(cnt, pa.int64())], ["ngram", "n", "cnt"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pc.binary_join_element_wise(batch.column("head"), batch.column("tail"), pa.scalar(b"", batch.column("head").type))
            if kept is not None:
                rows = pa.concat_arrays([kept, rows])
            data, at = _bytes(rows)
            size = np.diff(at)
            space = np.flatnonzero(data == 0)
            before = np.searchsorted(space, at)
            words = np.diff(before) + 1
            # bytes that a row shares with the one before it
            both = np.minimum(size[1:], size[:-1])
            upto = np.concatenate([[0], np.cumsum(both)])
            step = np.arange(upto[-1])
            other = np.flatnonzero(data[np.repeat(at[1:-1] - upto[:-1], both) + step] != data[np.repeat(at[:-2] - upto[:-1], both) + step])
            place = np.searchsorted(other, upto[:-1])
            stop = np.append(other, upto[-1])[place]
            shared = np.minimum(stop, upto[1:]) - upto[:-1]
            down = _DOWN[data]
            text, length, cnt, carry = [], [], [], {}
            for n in range(SHORT, LONG + 1):
                own = np.flatnonzero(words >= n)
                if not len(own):
                    continue
                end = np.append(space, 0)[np.minimum(before[own] + n - 1, len(space))]
                end = np.where(words[own] == n, at[own + 1], end)
                wide = np.zeros(len(rows), np.int64)
                wide[own] = end - at[own]
                same = (wide[own] == wide[own - 1]) & (wide[own] <= np.concatenate([[0], shared])[own])
                same[own == 0] = False
                run = np.flatnonzero(~same)
                times = np.ones(len(own), np.int64)
                if carried and own[0] == 0:
                    times[0] = carried[n]
                many = np.add.reduceat(times, run)
                if own[-1] == len(rows) - 1:
                    carry[n] = int(many[-1])
                    run, many = run[:-1], many[:-1]
                if most and len(best) == most:
                    high = many >= best[0]
                    run, many = run[high], many[high]
                text.append(_cut(down, at[own[run]], end[run], pa.string()))
                length.append(np.full(len(run), n))
                cnt.append(many)
            kept, carried = rows.slice(len(rows) - 1), carry
            yield given(text, length, cnt)
        if kept is not None:
            words = _DOWN[_bytes(kept)[0]].tobytes().split(b" ")
            yield given([pa.array([b" ".join(words[:n]).decode() for n in carried], pa.string())], [np.array(list(carried))], [np.array(list(carried.values()))])

    return counted


def phrase_counts(docs: DataFrame, words: Column, most: int | None = None) -> DataFrame:
    """ngram, n, cnt: how often each run of 2 to 7 words stands in the texts whose words are given; words hold no spaces.

    One row for each place is shuffled, keyed by its first two words, sorted, and counted for all six lengths in one pass over the sorted rows. Runs
    that begin with very frequent words are summed before they are shuffled, so that no task has all of them; which those are only decides the
    way. `most` leaves out runs that cannot be among so many with the greatest counts; ties of the least of these all stay.
    """
    texts = docs.select(F.array_join(words, " ").alias("text")).where(F.length("text") > 0)
    shape = "head binary, tail binary"
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(64)) == 0).mapInArrow(_places([], False), shape)
    heads = stored(some.groupBy("head").agg(F.count("*").alias("n")), "run-heads")
    total = heads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [bytes(r.head) for r in heads.where((F.col("n") > total / HOT) & (F.col("n") > 100)).collect()]  # fewer than HOT
    made = "ngram string, n int, cnt long"
    dealt = texts.mapInArrow(_places(hot, False), shape).repartition("head").sortWithinPartitions("head", "tail")
    rest = dealt.mapInArrow(_runs(most), made)
    if not hot:
        return rest
    often = texts.mapInArrow(_places(hot, True), shape).sortWithinPartitions("head", "tail").mapInArrow(_runs(None), made)
    return rest.unionByName(often.groupBy("ngram", "n").agg(F.sum("cnt").alias("cnt")))
