"""Substring dedup: Rabin-Karp hashes of every 20-word window, counted in Spark; repeated windows merge into
maximal removal intervals.

One pass hashes every window and sends its first place in each run of documents, packed, to the partition of
its hash; a window that repeats inside the run is settled there, so one hot window costs one entry a run.
The partition of a hash keeps the earliest place and sends the others, as intervals, to the partition of
their row. A second pass sends the texts there, compressed, where the intervals are merged and cut. Rows are known by
their place in the table, so that a null or repeated doc_id takes nothing from another row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ASCII_SPACE, ROW, U64, Words, buffers, deltas, down, ids, keyed, mapped, mix, pack, partitions_for, scaled, steps, text_bytes, unpack, up

#: Windows that a task gathers before it sorts and sends them.
RUN_WINDOWS = 1_000_000
WINDOWS, SPANS, TEXTS = 0, 1, 2
ROUTED = "part int, kind int, blob binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def _home(row: np.ndarray, parts: int) -> np.ndarray:
    """The partition of a row."""
    return scaled(mix(row.view(U64), 7), parts)


def _runs(row: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, sorted by row and place, as maximal (row, first start, last start)."""
    cut = np.flatnonzero((row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(row)]]) - 1
    return row[first], pos[first], pos[last]


def _spans(row: np.ndarray, pos: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    if not len(row):
        return
    order = np.lexsort((pos, row))
    row, first, last = _runs(row[order], pos[order])
    home = _home(row, parts)
    order = np.argsort(home, kind="stable")
    home = home[order]
    for sel in np.split(order, np.flatnonzero(home[1:] != home[:-1]) + 1):
        low, far = up(row[sel])
        yield int(_home(row[sel[:1]], parts)[0]), SPANS, np.int64(low).tobytes() + pack(far, first[sel], last[sel] - first[sel])


def _later(doc: np.ndarray, row: np.ndarray, pos: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Entries, sorted by group, that are not the earliest place of their group: by doc_id, then row, then start."""
    order = np.lexsort((pos, row, doc, group))
    head = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    at = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    return order[(row[order] != row[at]) | (pos[order] != pos[at])]


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted keys, and which of the sorted have an equal neighbour."""
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1], [False]])
    return order, same[1:] | same[:-1]


def _flush(key: np.ndarray, doc: np.ndarray, row: np.ndarray, pos: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    order, again = _repeats(key)
    keep = np.ones(len(key), bool)
    if again.any():
        sel = order[again]
        late = sel[_later(doc[sel], row[sel], pos[sel], key[sel])]
        keep[late] = False
        rows = list(_spans(row[late], pos[late], parts))
        if rows:
            yield _rows(rows)
    order = order[keep[order]]
    key, doc, row, pos = key[order], doc[order], row[order], pos[order]
    cuts = np.searchsorted(scaled(key, parts), np.arange(parts + 1))
    rows = []
    for p in np.flatnonzero(np.diff(cuts)):
        s = slice(cuts[p], cuts[p + 1])
        (low, far), (row_low, row_far) = up(doc[s]), up(row[s])
        rows.append((int(p), WINDOWS, np.array([low, row_low], np.int64).tobytes() + pack(deltas(key[s]), far, row_far, pos[s])))
    if rows:
        yield _rows(rows)


def _hash_windows(batches: Iterator[pa.RecordBatch], size: int, parts: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for batch in batches:
        for step in steps(batch):
            words = Words(*buffers(step.column("text")), ASCII_SPACE)
            h = words.windows(words.hashes(), size)
            whole = np.flatnonzero(words.text[: len(h)] == words.text[size - 1 :][: len(h)])
            text = words.text[whole]
            held.append((h[whole], ids(step.column("doc_id"))[text], ids(step.column(ROW))[text], whole - words.bound[text]))
            n += len(whole)
            if n >= RUN_WINDOWS:
                yield from _flush(*map(np.concatenate, zip(*held)), parts)
                held, n = [], 0
    if n:
        yield from _flush(*map(np.concatenate, zip(*held)), parts)


def _settle(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """All entries of some hashes: later places go on as intervals."""
    keys, docs, own, places = [], [], [], []
    for batch in batches:
        for part, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == SPANS:
                yield _rows([(part, kind, blob)])
                continue
            key, far, row_far, pos = unpack(blob[16:])
            low, row_low = np.frombuffer(blob, np.int64, 2).tolist()
            keys.append(np.cumsum(key, dtype=U64))
            docs.append(down(low, far))
            own.append(down(row_low, row_far))
            places.append(pos.astype(np.int32))
    if keys:
        key = np.concatenate(keys)
        keys.clear()
        order, again = _repeats(key)
        sel = order[again]
        if len(sel):
            doc, row, pos = np.concatenate(docs)[sel], np.concatenate(own)[sel], np.concatenate(places)[sel].astype(np.int64)
            late = _later(doc, row, pos, key[sel])
            rows = list(_spans(row[late], pos[late], parts))
            if rows:
                yield _rows(rows)


def _send_texts(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    n = 0

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        home = _home(ids(table.column(ROW).combine_chunks()), parts)
        order = np.argsort(home, kind="stable")
        rows = []
        for sel in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table.take(pa.array(sel)))
            rows.append((int(home[sel[0]]), TEXTS, zstandard.ZstdCompressor(3).compress(sink.getvalue())))
        return _rows(rows)

    for batch in batches:
        for step in steps(batch, most=16 << 20):
            if step.num_rows:
                held.append(step)
                n += step.column("text").nbytes
            if n >= 16 << 20:
                yield flush()
                held, n = [], 0
    if held:
        yield flush()


def _cut(batches: Iterator[pa.RecordBatch], size: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """Texts and intervals of some rows, to what is left of each."""
    blobs, rows, firsts, lasts = [], [], [], []
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist()):
            if kind == TEXTS:
                blobs.append(blob)
            else:
                far, first, more = unpack(blob[8:])
                rows.append(down(int(np.frombuffer(blob, np.int64, 1)[0]), far))
                firsts.append(first.astype(np.int64))
                lasts.append((first + more).astype(np.int64))
    row, first, last = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, firsts, lasts))
    order = np.argsort(row, kind="stable")
    row, first, last = row[order], first[order], last[order]
    for blob in blobs:
        with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)) as r:
            table = r.read_all().combine_chunks()
        for step in table.to_batches():
            yield from _cut_step(step, row, first, last, size, texts)


def _cut_step(step: pa.RecordBatch, row: np.ndarray, first: np.ndarray, last: np.ndarray, size: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in steps(step):
        own = ids(batch.column(ROW))
        data, offsets = buffers(batch.column("text"))
        words = Words(data, offsets, ASCII_SPACE)
        lo, hi = np.searchsorted(row, own, "left"), np.searchsorted(row, own, "right")
        n = hi - lo
        text = np.repeat(np.arange(len(own)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        edge = np.zeros(len(words.start) + 1, np.int64)
        most = words.count[text]
        np.add.at(edge, words.bound[text] + np.minimum(first[at], most), 1)
        np.add.at(edge, words.bound[text] + np.minimum(last[at] + size, most), -1)
        gone = np.cumsum(edge)[:-1] > 0
        removed = np.add.reduceat(np.concatenate([gone, [0]]).astype(np.int64), words.bound[:-1]) * (words.count > 0) if len(own) else n
        # The byte after a kept word is white space when another kept word follows; it becomes the one space.
        kept = np.flatnonzero(~gone)
        follows = np.zeros(len(kept), bool)
        follows[:-1] = words.text[kept][1:] == words.text[kept][:-1]
        mark = np.zeros(len(data) + 1, np.int8)
        mark[words.start[kept]] = 1
        np.add.at(mark, words.end[kept], -1)
        stay = np.cumsum(mark[:-1], dtype=np.int8) > 0
        out = data.copy()
        spaces = words.end[kept][follows]
        out[spaces], stay[spaces] = 32, True
        left = np.concatenate([[0], np.cumsum(stay)])[offsets]
        rest = out[stay].tobytes()
        pieces = [rest[a:b] for a, b in zip(left[:-1], left[1:])]
        columns = [batch.column("doc_id"), pa.array(words.count, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in pieces])]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        yield pa.record_batch(columns + [pa.array([x.decode() for x in pieces])] * texts, names + ["kept_text"] * texts)


def substring_dedup(docs: DataFrame, size: int = 20, texts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with texts, kept_text: one row for each input row.

    Words are runs of anything but ASCII white space. A word goes when a window of `size` words over it has
    the same words as a window that starts earlier (smaller doc_id, or earlier in the same document); windows
    are those of the input. Null texts and texts without words give counts of 0 and an empty rest. A null
    doc_id sorts first. Rows that share a doc_id, or have none, are rows of their own, and the one that stands first in the
    table is the earlier. Other columns are ignored; no rows give no rows. Windows are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    base = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).select(ROW, "doc_id", "text")
    parts = partitions_for(spark, text_bytes(base))
    windows = mapped(base, lambda b: _hash_windows(b, size, parts), ROUTED).repartitionById(parts, "part")
    spans = mapped(windows, lambda b: _settle(b, parts), ROUTED)
    sent = mapped(base, lambda b: _send_texts(b, parts), ROUTED)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return mapped(sent.unionByName(spans).repartitionById(parts, "part"), lambda b: _cut(b, size, texts), out)
