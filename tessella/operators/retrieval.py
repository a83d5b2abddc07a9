"""Exact nearest neighbours, BM25, and lookups of neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .storage import stored

#: Query vectors in one block: a block goes to every task, so its size is bounded.
QUERY_BLOCK = 4096
CORPUS_STEP = 8192
#: Queries that are scored against a step at once.
SCORED = 128
#: Words of the queries in one block of a BM25 search, and documents that one step scores.
BM25_BLOCK = 50_000
BM25_STEP = 256


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _scores(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    if metric == "ip":
        return q @ c.T
    return (q * q).sum(1)[:, None] - 2 * (q @ c.T) + (c * c).sum(1)[None, :]


def _best(score: np.ndarray, pid: np.ndarray, k: int, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, ties by id. All that are as good as the k-th are found without sorting; only those are sorted."""
    if score.shape[1] > 2 * k:
        by = sign * score
        least = np.partition(by, k - 1, axis=1)[:, k - 1 : k]
        n = max(k, int((by <= least).sum(axis=1).max(initial=0)))
        if n < by.shape[1]:
            near = np.argpartition(by, n - 1, axis=1)[:, :n]
            score, pid = np.take_along_axis(score, near, 1), np.take_along_axis(pid, near, 1)
    order = np.lexsort((pid, sign * score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(pid, order, 1)


def _local_top(batches: Iterator[pa.RecordBatch], qid: np.ndarray, q: np.ndarray, k: int, metric: str) -> Iterator[pa.RecordBatch]:
    sign, best = (-1 if metric == "ip" else 1), None
    for batch in batches:
        for at in range(0, batch.num_rows, CORPUS_STEP):
            step = batch.slice(at, CORPUS_STEP)
            c = _matrix(step.column("v"))
            pid = step.column("pid").to_numpy(zero_copy_only=False).astype(np.int64)
            for part in range(0, len(qid), SCORED):  # bounds the score matrix
                rows = slice(part, part + SCORED)
                score = _scores(q[rows], c, metric)
                kept = _best(score, np.broadcast_to(pid, score.shape), k, sign)
                if best is not None:
                    kept = _best(np.concatenate([best[0][rows], kept[0]], 1), np.concatenate([best[1][rows], kept[1]], 1), k, sign)
                new = kept if part == 0 else (np.concatenate([new[0], kept[0]]), np.concatenate([new[1], kept[1]]))
            best = new
    if best is not None:
        n = best[0].shape[1]
        yield pa.record_batch([pa.array(np.repeat(qid, n)), pa.array(best[1].ravel()), pa.array(best[0].ravel())], ["qid", "pid", "score"])


def knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "ip", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """qid, pid, score, rank: the k best of the corpus for each query, exactly; a query in the corpus finds itself.

    metric is "ip" (inner product, descending) or "l2" (squared distance, ascending); ties go by pid. Every partition of the
    corpus gives its own k best (matrix products on Arrow batches), which are then ranked together: at most k
    rows for each partition and query are shuffled. Queries go out in blocks of bounded size.
    """
    base = corpus.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("pid"), F.col(vector_col).alias("v"))
    asked = queries.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("qid"), F.col(vector_col).alias("v"))
    found = _in_blocks(asked, "qid", asked.count(), QUERY_BLOCK, lambda block: base.mapInArrow(partial(_local_top, qid=block.column("qid").to_numpy(), q=_matrix(block.column("v")), k=k, metric=metric), _HITS))
    return merge_top(found, k, ascending=metric == "l2")


_HITS = "qid long, pid long, score double"


def _in_blocks(asked: DataFrame, key: str, size: int, block_size: int, run: Callable[[pa.Table], DataFrame]) -> DataFrame:
    """The hits of all queries, block by block. With several blocks each one's hits are stored before the next is read, so the driver
    and the tasks hold one block at a time."""
    blocks = max(1, -(-size // block_size))
    if blocks == 1:
        block = asked.toArrow()
        return run(block) if block.num_rows else asked.sparkSession.createDataFrame([], _HITS)
    parts = [stored(run(block), "hits") for b in range(blocks) if (block := asked.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).toArrow()).num_rows]
    return reduce(DataFrame.unionByName, parts)


def merge_top(hits: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    """The k best hits of each query out of several lists; rank from 1, ties by pid."""
    by = F.col("score").asc() if ascending else F.col("score").desc()
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(by, "pid"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "pid", "score", "rank")


def attach_neighbors(queries: DataFrame, hits: DataFrame, id_col: str = "qid") -> DataFrame:
    """queries with `neighbors`: the pids of their hits by rank; none gives an empty array."""
    lists = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pid"))), lambda x: x["pid"]).alias("neighbors"))
    joined = queries.join(lists, queries[id_col] == lists["qid"], "left")
    return joined.select(*[queries[c] for c in queries.columns], F.coalesce(lists["neighbors"], F.array().cast("array<bigint>")).alias("neighbors"))


def gather(lists: DataFrame, values: DataFrame, id_col: str, list_col: str, key: str, value: str, out: str) -> DataFrame:
    """id_col and `out`: the value of every listed key, in order, repeats kept; keys that are missing are left out."""
    placed = lists.select(id_col, F.posexplode(list_col).alias("_pos", "_key"))
    found = placed.join(values.select(F.col(key).alias("_key"), F.col(value).alias("_value")), "_key")
    rows = found.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_value"))), lambda x: x["_value"]).alias(out))
    kind = dict(rows.dtypes)[out]
    return lists.select(id_col).join(rows, id_col, "left").select(id_col, F.coalesce(out, F.array().cast(kind)).alias(out))


def pad_missing(neighbors: Column, n: int) -> Column:
    """Negative ids removed, then filled up to n with -1 for a zero vector."""
    known = F.filter(neighbors, lambda x: x >= 0)
    return F.concat(known, F.array_repeat(F.lit(-1).cast("long"), F.greatest(F.lit(n) - F.size(known), F.lit(0))))


def _bm25_top(batches: Iterator[pa.RecordBatch], term: pa.Array, idf: np.ndarray, asked: np.ndarray, bound: np.ndarray, qid: np.ndarray, k: int, k1: float, b: float, avgdl: float) -> Iterator[pa.RecordBatch]:
    """The k best of a partition for each query. asked: queries by term, those of term t from bound[t] to bound[t + 1]."""
    best: tuple[np.ndarray, np.ndarray] | None = None
    for batch in batches:
        for at in range(0, batch.num_rows, BM25_STEP):
            step = batch.slice(at, BM25_STEP)
            words, pid = step.column("w"), step.column("pid").to_numpy(zero_copy_only=False)
            size = pc.list_value_length(words).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            t = pc.fill_null(pc.index_in(words.flatten(), value_set=term), -1).to_numpy(zero_copy_only=False)
            cell, tf = np.unique(t[t >= 0].astype(np.int64) * len(size) + row[t >= 0], return_counts=True)
            t, row = cell // len(size), cell % len(size)
            part = idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[row] / avgdl))
            cut = np.flatnonzero(np.diff(t, prepend=-1))
            score = np.zeros((len(qid), len(size)))
            for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(t)]):
                q = asked[bound[t[x]] : bound[t[x] + 1]]
                score[np.ix_(q, row[x:y])] += part[x:y]
            score[score == 0] = -np.inf  # shares no word
            score = np.round(score, 6)
            if best is None:
                best = np.full((len(qid), k), -np.inf), np.full((len(qid), k), np.iinfo(np.int64).max)
            better = np.flatnonzero((score >= np.maximum(best[0][:, -1:], np.finfo(float).min)).any(axis=1))  # queries with a new hit
            ids = np.broadcast_to(pid, (len(better), len(pid)))
            best[0][better], best[1][better] = _best(np.concatenate([best[0][better], score[better]], 1), np.concatenate([best[1][better], ids], 1), k, -1)
    if best is not None:
        hit = best[0] > -np.inf
        yield pa.record_batch([pa.array(np.repeat(qid, hit.sum(1))), pa.array(best[1][hit]), pa.array(best[0][hit])], ["qid", "pid", "score"])


def bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = 0.82, b: float = 0.68, query_id: str = "item_id", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """qid, pid, score, rank of the k best documents by BM25 over lower-cased alphanumeric words.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)). A query's words count once. Document frequencies are counted per task first; then blocks
    of queries of bounded size go to the documents, and every partition gives its own k best: what a frequent word has in
    common with many queries and documents is summed where it is read and never shuffled.
    Without stemming, stop words and lossy norms, so scores differ from an index that has them.
    """
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    sized = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("pid"), words(F.col(text)).alias("w"))
    asked = queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).cast("long").alias("qid"), F.explode(F.array_distinct(words(F.col(text)))).alias("term")).distinct()
    total = sized.agg(F.count("*"), F.avg(F.size("w"))).first()
    df = sized.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(total[0]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = stored(asked.join(df, "term").select("qid", "term", idf.alias("idf")), "bm25-asked")

    def run(block: pa.Table) -> DataFrame:
        term = block.column("term").combine_chunks().dictionary_encode()
        qid, q = np.unique(block.column("qid").to_numpy(), return_inverse=True)
        t = term.indices.to_numpy()
        order = np.argsort(t, kind="stable")
        bound = np.searchsorted(t[order], np.arange(len(term.dictionary) + 1))
        known = np.zeros(len(term.dictionary))
        known[t] = block.column("idf").to_numpy()
        return sized.mapInArrow(partial(_bm25_top, term=term.dictionary, idf=known, asked=q[order], bound=bound, qid=qid, k=k, k1=k1, b=b, avgdl=total[1]), _HITS)

    return merge_top(_in_blocks(asked, "qid", asked.count(), BM25_BLOCK, run), k)


def hard_negatives(vectors: DataFrame, depth: int = 101) -> DataFrame:
    """Self search to a depth without the query itself: near texts that are not the same."""
    hits = knn(vectors, vectors, depth)
    return hits.where("qid <> pid").select("qid", "pid", "score", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "pid")).alias("rank"))


def token_lengths(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("n_words", F.size(tokens(F.col(text))))
