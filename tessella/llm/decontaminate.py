"""Benchmark decontamination on a distributed positional inverted index.

The index is a table of segments. A segment holds whole documents: its terms in hash order, and for each the
places where it stands, counted through the segment with a gap after every document. A query takes a window's
terms from the rarest of the segment on, shifts each list of places by the term's offset and intersects.
Segments are searched where they are read: nothing is shuffled but the benchmark, which goes out in blocks of
bounded size.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import NOT_ALNUM, ROW, U64, Words, buffers, deltas, down, ids, keyed, mapped, pack, steps, stored, text_bytes, unpack, up

WINDOW = 10
#: Words of a segment, as far as whole documents allow.
SEGMENT_WORDS = 500_000
#: Bytes of benchmark text that one search carries; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 4 << 20
#: Places that one step of a search compares.
PAIRS = 1 << 20
#: Places left free after a document, so that no window reaches the next.
GAP = 1 << 10


# ---------------------------------------------------------------- the index


def _segment(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    doc, count, term = map(np.concatenate, zip(*held))
    base = np.cumsum(count + GAP) - count - GAP
    place = np.arange(len(term)) + np.repeat(base - (np.cumsum(count) - count), count)
    order = np.argsort(term, kind="stable")
    term, place = term[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    step = place.copy()
    step[1:] -= place[:-1]
    step[first] = place[first]
    low, far = up(doc)
    blobs = [np.int64(low).tobytes() + pack(far, count), pack(deltas(term[first]), np.diff(np.append(first, len(term)))), pack(step)]
    return pa.record_batch([pa.array([b], pa.binary()) for b in (uuid.uuid4().bytes, *blobs)], ["segment", "docs", "terms", "places"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        for step in steps(batch):
            words = Words(*buffers(step.column("text")), NOT_ALNUM, fold=True)
            held.append((ids(step.column("doc_id")), words.count, words.hashes()))
            n += len(words.start)
            if n >= SEGMENT_WORDS:
                yield _segment(held)
                held, n = [], 0
    if held:
        yield _segment(held)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: one row for each segment, with a name of its own. A null text has no words; a null doc_id is kept as one."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(mapped(base, _index, "segment binary, docs binary, terms binary, places binary"), "positional-index")


class Segment:
    def __init__(self, docs: bytes, terms: bytes, places: bytes, wanted: np.ndarray):
        """wanted: sorted hashes of the terms that queries use."""
        far, count = unpack(docs[8:])
        self.doc = down(int(np.frombuffer(docs, np.int64, 1)[0]), far)
        self.count = count.astype(np.int64)
        self.base = np.cumsum(self.count + GAP) - self.count - GAP
        term, df = unpack(terms)
        term = np.cumsum(term, dtype=U64)
        (step,) = unpack(places)
        first = np.concatenate([[0], np.cumsum(df.astype(np.int64))])
        at = np.searchsorted(term, wanted)
        here = (at < len(term)) & (term[np.minimum(at, len(term) - 1)] == wanted) if len(term) else np.zeros(len(wanted), bool)
        df = df.astype(np.int64)
        self.rows = np.where(here, at, -1)
        self.df = np.where(here, df[np.minimum(at, max(len(term) - 1, 0))], 0) if len(term) else np.zeros(len(wanted), np.int64)
        total = np.concatenate([[0], np.cumsum(step.astype(np.int64))])
        self.first = first[self.rows]
        self.all_places = total[1:] - np.repeat(total[first[:-1]], df)
        self.size = int(self.base[-1] + self.count[-1] + GAP) if len(self.doc) else 0

    def places(self, k: int) -> np.ndarray:
        """Where the k-th wanted term stands, in order."""
        return self.all_places[self.first[k] : self.first[k] + self.df[k]]

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of several wanted terms, list after list, and which of the terms each belongs to."""
        n = self.df[terms]
        own = np.repeat(np.arange(len(terms)), n)
        return self.all_places[np.arange(len(own)) + np.repeat(self.first[terms] - (np.cumsum(n) - n), n)], own

    def phrases(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of `windows` (wanted terms, -1 behind shorter ones) and places where their terms follow one another.

        All windows whose terms the segment has are taken at once: the list of each one's rarest term, shifted by its offset, is
        intersected with those of its other terms, the rarer ones first, some PAIRS places at a time.
        """
        pad = windows < 0
        held = np.flatnonzero((pad | (self.df[windows] > 0)).all(axis=1))
        if not len(held):
            return
        windows, pad = windows[held], pad[held]
        offsets = np.argsort(np.where(pad, np.iinfo(np.int64).max, self.df[windows]), axis=1, kind="stable")
        rarest = windows[np.arange(len(held)), offsets[:, 0]]
        used = np.unique(windows[~pad])
        at, own = self.postings(used)
        term_at = np.full(self.size + windows.shape[1], -1, np.int64)  # the lists of all used terms, side by side
        term_at[at] = used[own]
        upto = np.cumsum(self.df[rarest])
        a = 0
        while a < len(held):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
            place, own = self.postings(rarest[a:b])
            row = own + a
            start = place - offsets[row, 0]
            row, start = row[start >= 0], start[start >= 0]
            for k in range(1, windows.shape[1]):
                offset = offsets[row, k]
                term = windows[row, offset]
                same = (term < 0) | (term_at[start + offset] == term)
                row, start = row[same], start[same]
            yield held[row], start
            a = b

    def near(self, terms: np.ndarray, reach: int) -> np.ndarray:
        """Places of the rarest term that have every other term of the set at most `reach` words away."""
        terms = np.unique(terms)
        order = terms[np.argsort(self.df[terms], kind="stable")]
        found = self.places(order[0])
        for k in order[1:].tolist():
            other = self.places(k)
            at = np.searchsorted(other, found - reach)
            found = found[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] <= found + reach)]
        return found

    def texts(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, places, "right") - 1


# ---------------------------------------------------------------- queries


class Phrases:
    """Windows of a block of benchmark items: term numbers of each distinct window, and the items that have it."""

    def __init__(self, items: pa.Table, window: int):
        words = Words(*buffers(items.column("text")), NOT_ALNUM, fold=True)
        self.terms, number = np.unique(words.hashes(), return_inverse=True)
        names = items.column("item_id").to_pylist()
        owners: dict[tuple[int, ...], set[int]] = {}
        self.sets = []
        for k, item in enumerate(names):
            own = number[words.bound[k] : words.bound[k + 1]].tolist()
            for i in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(tuple(own[i : i + window]), set()).add(item)
            if own:
                self.sets.append((np.unique(own), item))
        self.length = np.array([len(w) for w in owners], np.int64)
        self.windows = np.full((len(owners), window), -1, np.int64)
        for k, w in enumerate(owners):
            self.windows[k, : len(w)] = w
        self.items = np.array([i for x in owners.values() for i in sorted(x)], np.int64)
        self.owned = np.concatenate([[0], np.cumsum([len(x) for x in owners.values()])]).astype(np.int64)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[int, Iterator[pa.Table]]:
    base = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    n = max(1, -(-text_bytes(base) // BLOCK_BYTES))
    return n, (base.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).toArrow() for k in range(n))  # BLOCK_BYTES at a time reach the driver


#: segment and row, its place there, tell document rows apart; doc_id may be null or repeated.
_FOUND = "segment binary, row long, doc_id long, n_words long, hit binary, items array<long>"


def _search(batches: Iterator[pa.RecordBatch], phrases: Phrases, reach: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, *row in zip(*(batch.column(c).to_pylist() for c in ("segment", "docs", "terms", "places"))):
            seg = Segment(*row, phrases.terms)
            edge = np.zeros(seg.size + 1, np.int32)
            pairs: list[np.ndarray] = []
            if reach is None:
                for k, at in seg.phrases(phrases.windows):
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + phrases.length[k], -1)
                    found = np.unique(np.stack([seg.texts(at), k], axis=1), axis=0)
                    n = phrases.owned[found[:, 1] + 1] - phrases.owned[found[:, 1]]
                    item = np.arange(int(n.sum())) + np.repeat(phrases.owned[found[:, 1]] - (np.cumsum(n) - n), n)
                    pairs.append(np.stack([np.repeat(found[:, 0], n), phrases.items[item]], axis=1))
            else:
                for terms, item in phrases.sets:
                    if (seg.rows[terms] >= 0).all() and len(at := seg.near(terms, reach)):
                        edge[at] += 1
                        edge[at + 1] -= 1
                        text = np.unique(seg.texts(at))
                        pairs.append(np.stack([text, np.full(len(text), item)], axis=1))
            hit = np.cumsum(edge[:-1]) > 0
            found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
            cut = np.searchsorted(found[:, 0], np.arange(len(seg.doc) + 1))
            doc = pa.array(seg.doc, pa.int64(), mask=seg.doc == -(2**63))
            own = [np.packbits(hit[b : b + c]).tobytes() for b, c in zip(seg.base.tolist(), seg.count.tolist())]
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(found[:, 1], pa.int64()))
            key = [pa.array([name] * len(seg.doc), pa.binary()), pa.array(np.arange(len(seg.doc)), pa.int64())]
            yield pa.record_batch([*key, doc, pa.array(seg.count, pa.int64()), pa.array(own, pa.binary()), lists], ["segment", "row", "doc_id", "n_words", "hit", "items"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [int(np.bitwise_count(np.frombuffer(x, np.uint8)).sum()) for x in batch.column("hit").to_pylist()]
        items = [sorted(map(str, x or ())) for x in batch.column("items").to_pylist()]
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        yield pa.record_batch([batch.column("doc_id"), batch.column("n_words"), pa.array(n, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha), pa.array([x > 0 for x in n], pa.bool_()), batch.column("hit"), batch.column("items")], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit", "items"])


def _either(one: bytes, two: bytes) -> bytes:
    return np.bitwise_or(np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)).tobytes()


def _merged(table: pa.Table) -> pa.Table:
    """The finds of several blocks for one document row."""
    hit = table.column("hit").to_pylist()
    for x in hit[1:]:
        hit[0] = _either(hit[0], x)
    items = sorted({i for x in table.column("items").to_pylist() for i in x})
    return table.slice(0, 1).select(["segment", "row", "doc_id", "n_words"]).append_column("hit", pa.array(hit[:1], pa.binary())).append_column("items", pa.array([items], pa.list_(pa.int64())))


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, reach: int | None = None, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Finds in every document of the index: n_hit words, the items, and hit, a bit for each word.

    Exact phrases of `window` words of an item (a shorter item is one phrase), or with `reach` proximity: all words
    of an item within `reach` words of its rarest. Both stay below the gap that the index leaves between documents, else a
    ValueError is raised.
    """
    if max(window, (reach or 0) + 1) > GAP:
        raise ValueError(f"windows and reach must be below the gap of {GAP} words between documents")
    scan = lambda block: mapped(index, lambda b, p=Phrases(block, window): _search(b, p, reach), _FOUND)
    n, blocks = _blocks(benchmark, id_col, text_col)
    if n == 1:
        all_ = scan(next(blocks))
    else:  # the finds of each block are stored, so that one block at a time is on the driver
        all_ = reduce(DataFrame.unionByName, [stored(scan(block), "finds") for block in blocks])
        all_ = all_.groupBy("segment", "row").applyInArrow(_merged, _FOUND)
    return mapped(all_, _digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit binary, items array<long>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, reach: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit, items: one row for each document.

    Words are runs of ASCII letters, digits and all non-ASCII characters, A-Z in lower case. Null and empty
    texts have no words and no hits; items without words are in nothing; items without an id are left out,
    repeated ones count once. A document row without an id keeps a null one. An empty benchmark hits nothing; no documents give no rows. Other columns are
    ignored. Words are told apart by 64-bit hashes.
    """
    return search(build_index(docs), benchmark, window, reach)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without a word of a benchmark window, with all their columns. Each row is judged by itself, also
    where its id is null or repeated."""
    rows = keyed(docs)
    hit = search(build_index(rows, id_col=ROW), benchmark, window).where("contaminated").select(F.col("doc_id").alias(ROW))
    return rows.join(hit, ROW, "left_anti").select(*docs.columns)
