"""A stored text index: posting blocks with the largest score of each, and a top-k search that skips blocks.

Documents are cut into segments of a bounded number. A segment's postings of a word are blocks of at most BLOCK documents, each
with the words' weights (BM25 without the idf) and the largest of them. Files are sorted by word: of a few words the scan's filter
leaves the row groups that hold them, of many those between the first and the last. A search sums a query's words from the weightiest
on; once what the remaining words could add is less than what the k-th best already has, only documents that could still reach it
are looked up, and blocks without any are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.procedural import text_slices
from ..functions.stems import stem
from .retrieval import _HITS, _in_blocks, merge_top
from .storage import new_path, stored

#: Documents of a segment, and of a block of postings.
SEGMENT, BLOCK = 8192, 128
#: Words of the queries that one search reads at once.
ASKED = 20_000
#: A bound is passed only by more than rounding can make.
SLACK = 1e-5
_WORD = re.compile("[a-z0-9]+")
_POSTINGS = "term string, segment long, block int, first int, pids array<long>, places array<int>, weights array<double>, most double"


def analyzed(text: str | None, stemmed: bool) -> list[str]:
    """Words of a text: runs of a-z and 0-9 after lower-casing, in order; stemmed by Porter's rules if asked."""
    words = _WORD.findall((text or "").lower())
    return [stem(w) for w in words] if stemmed else words


def _analyze(batches: Iterator[pa.RecordBatch], stemmed: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for texts in text_slices(batch.column("text")):
            words = pa.array([analyzed(t, stemmed) for t in texts.to_pylist()], pa.list_(pa.string()))
            yield pa.record_batch([batch.column(0).slice(at, len(texts)), words], [batch.schema.names[0], "words"])
            at += len(texts)


def _segment(segment: int, pid: np.ndarray, words: pa.ListArray, k1: float, b: float, average: float) -> pa.RecordBatch:
    """Posting blocks of one segment, by word."""
    coded = words.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    terms, by_code = coded.dictionary.take(order), np.empty(len(order), np.int64)
    by_code[order.to_numpy()] = np.arange(len(order))
    code = by_code[coded.indices.to_numpy()]
    size = pc.list_value_length(words).to_numpy()
    cell, tf = np.unique(code * len(pid) + np.repeat(np.arange(len(pid)), size), return_counts=True)
    term, place = cell // len(pid), cell % len(pid)
    weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[place] / average))
    new = np.flatnonzero(np.diff(term, prepend=-1))
    rank = np.arange(len(term)) - np.repeat(new, np.diff(np.append(new, len(term))))
    cut = np.flatnonzero(rank % BLOCK == 0)
    bound = pa.array(np.append(cut, len(term)), pa.int32())
    lists = [pa.ListArray.from_arrays(bound, pa.array(x)) for x in (pid[place], place.astype(np.int32), weight)]
    most = np.maximum.reduceat(weight, cut) if len(cut) else np.zeros(0)
    first = [terms.take(pa.array(term[cut])), pa.array(np.full(len(cut), segment)), pa.array((rank[cut] // BLOCK).astype(np.int32)), pa.array(place[cut].astype(np.int32))]
    return pa.record_batch([*first, *lists, pa.array(most)], ["term", "segment", "block", "first", "pids", "places", "weights", "most"])


def _post(batches: Iterator[pa.RecordBatch], k1: float, b: float, average: float) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    parts, held, n = [], 0, 0
    number = lambda: (TaskContext.get().partitionId() << 33) + n
    segment = lambda: _segment(number(), table.column("pid").to_numpy(), table.column("words").combine_chunks(), k1, b, average)
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            parts.append(batch.slice(at, SEGMENT - held))
            at, held = at + parts[-1].num_rows, held + parts[-1].num_rows
            if held == SEGMENT:
                table, parts, held = pa.Table.from_batches(parts), [], 0
                yield segment()
                n += 1
    if parts:
        table = pa.Table.from_batches(parts)
        yield segment()


def best_of_segment(lists: list[tuple[float, list[tuple[np.ndarray, np.ndarray, float]]]], size: int, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Places and scores that hold the k best, blocks read and blocks skipped. lists: each word's idf and its blocks (places, weights, largest weight)."""
    bound = np.array([idf * max(b[2] for b in blocks) for idf, blocks in lists])
    lists = [lists[i] for i in np.argsort(-bound, kind="stable")]
    rest = np.append(np.cumsum(np.sort(bound))[::-1], 0.0)
    score, read, skipped = np.zeros(size), 0, 0
    for i, (idf, blocks) in enumerate(lists):
        least = np.partition(score, size - k)[size - k] if k <= size else 0.0
        if rest[i] + SLACK < least:  # no other document can come up any more
            able = score + rest[i] + SLACK >= least
            hopeful = np.concatenate([[0], np.cumsum(able)])
            for places, weights, most in blocks:
                spot = able[places] if hopeful[places[-1] + 1] > hopeful[places[0]] else None
                # a block is also skipped where not even its largest weight lifts any of its documents
                if spot is None or not (spot & (score[places] + idf * most + rest[i + 1] + SLACK >= least)).any():
                    skipped += 1
                    continue
                read += 1
                score[places] += idf * weights
        else:
            for places, weights, _ in blocks:
                read += 1
                score[places] += idf * weights
    found = np.flatnonzero(score > 0)
    if len(found) > k:
        found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k] - SLACK]
    return found, score[found], read, skipped


def _search(table: pa.Table, asked: dict[int, list[tuple[str, float]]], k: int, counts: bool) -> pa.Table:
    """The k best of a segment for each query, or the blocks that it read and skipped."""
    columns = [table.column(c).to_pylist() for c in ("term", "block", "most")]
    pids, places, weights = (table.column(c).combine_chunks() for c in ("pids", "places", "weights"))
    of: dict[str, list[tuple[np.ndarray, np.ndarray, float]]] = {}
    number: dict[int, int] = {}
    for row in sorted(range(table.num_rows), key=lambda r: columns[1][r]):
        at = places[row].values.to_numpy()
        of.setdefault(columns[0][row], []).append((at, weights[row].values.to_numpy(), columns[2][row]))
        number.update(zip(at.tolist(), pids[row].values.to_pylist()))
    out = []
    for qid, terms in asked.items():
        lists = [(idf, of[t]) for t, idf in terms if t in of]
        if lists:
            found, score, read, skipped = best_of_segment(lists, max(number) + 1, k)
            if counts:
                out.append((qid, read, float(skipped)))
                continue
            hits = sorted((-round(s, 6), number[p]) for p, s in zip(found.tolist(), score.tolist()))[:k]
            out += [(qid, p, -s) for s, p in hits]
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["qid", "pid", "score"])


class TextIndex:
    """Posting blocks, document frequencies and totals, stored at `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.postings, self.frequencies = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/frequencies")
        self.documents, self.stemmed = spark.read.parquet(f"{path}/about").select("documents", "stemmed").first()

    @classmethod
    def build(cls, docs: DataFrame, stemmed: bool = False, k1: float = 0.82, b: float = 0.68, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> TextIndex:
        """An index of all rows with an id and a text. Rows that repeat an id are documents of their own."""
        spark, path = docs.sparkSession, path or new_path(docs.sparkSession, "text-index")
        rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("pid"), F.col(text_col).alias("text"))
        words = stored(rows.mapInArrow(partial(_analyze, stemmed=stemmed), "pid long, words array<string>"), "analyzed")
        count, average = words.agg(F.count("*"), F.coalesce(F.avg(F.size("words")), F.lit(0.0))).first()
        words.mapInArrow(partial(_post, k1=k1, b=b, average=average or 1.0), _POSTINGS).sortWithinPartitions("term", "segment", "block").write.parquet(f"{path}/postings")
        spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.sum(F.size("pids")).alias("df")).write.parquet(f"{path}/frequencies")
        spark.range(1).select(F.lit(count).alias("documents"), F.lit(stemmed).alias("stemmed")).write.parquet(f"{path}/about")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int, counts: bool = False, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
        """qid, pid, score, rank: the k best documents of each query, whose words count once. counts: instead of hits, a row for each query and
        segment with the blocks read (pid) and skipped (score)."""
        asked = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("qid"), F.col(text_col).alias("text"))
        terms = asked.mapInArrow(partial(_analyze, stemmed=self.stemmed), "qid long, words array<string>").select("qid", F.explode(F.array_distinct("words")).alias("term")).distinct()
        idf = F.log(1 + (F.lit(self.documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        terms = stored(terms.join(self.frequencies, "term").select("qid", "term", idf.alias("idf")), "asked")

        def run(block: pa.Table) -> DataFrame:
            by_query: dict[int, list[tuple[str, float]]] = {}
            for qid, term, weight in zip(*(block.column(c).to_pylist() for c in ("qid", "term", "idf"))):
                by_query.setdefault(qid, []).append((term, weight))
            by_query = {q: sorted(t) for q, t in by_query.items()}
            some = sorted(set(block.column("term").to_pylist()))
            near = self.postings.where(F.col("term").isin(some))
            return near.groupBy("segment").applyInArrow(lambda table: _search(table, by_query, k, counts), _HITS)

        found = _in_blocks(terms, "qid", terms.count(), ASKED, run)
        return found if counts else merge_top(found, k)
