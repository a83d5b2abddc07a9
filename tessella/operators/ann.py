"""Approximate nearest neighbours: stored indexes chosen by a factory string.

    Flat            all vectors, exact
    IVF64,Flat      64 cells around k-means centroids; a query reads the vectors of its nearest cells
    IVF64,PQ8       the same over residuals coded in 8 bytes; the best by code are scored again by their vectors
    HNSW16,Flat     a small-world graph of 16 neighbours for every shard of vectors, searched by beams

An index is fitted on a bounded sample (TRAIN_ROWS vectors, chosen by hash) and holds every vector. How many cells, or how wide a beam, a search
takes is measured on the same sample, so that the share of true neighbours found there reaches a target. `exact=True` searches
the stored vectors without the index. Inner products are searched as distances, by one more component that levels the norms.
"""

from __future__ import annotations

import json
import pickle
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import _HITS, _in_blocks, _matrix, knn, merge_top
from .storage import new_path

#: Vectors that an index is fitted on at most, and the codebooks of them; rounds of k-means, and entries of a code's byte at most.
TRAIN_ROWS, CODE_ROWS, ROUNDS, ENTRIES = 16_384, 4096, 12, 256
#: Share of true neighbours that a search should find, measured on queries of the sample.
TARGET, MEASURED, MEASURED_K = 0.93, 128, 10
#: Vectors of a graph's shard, random long links of a vector, places where beams begin, and queries that one beam step moves.
SHARD_ROWS, LONG_LINKS, ENTRANCES, BEAM_QUERIES = 8192, 4, 256, 256
#: Rows that one step scores, candidates by code for each wanted neighbour, and queries of a block.
STEP, AGAIN, BLOCK = 8192, 8, 4096
#: Rows that are coded, and queries that are scored against a step, at once: bounds of the distance matrices.
CODED, SCORED = 1024, 128


@dataclass(frozen=True)
class Factory:
    kind: str  # flat, ivf or graph
    cells: int = 0
    code_bytes: int = 0
    links: int = 0


def factory(text: str) -> Factory:
    """Factory of a string such as "IVF64,PQ8"."""
    if text == "Flat":
        return Factory("flat")
    if m := re.fullmatch(r"IVF([1-9]\d*),(?:Flat|PQ([1-9]\d*))", text):
        return Factory("ivf", cells=int(m[1]), code_bytes=int(m[2] or 0))
    if m := re.fullmatch(r"HNSW([1-9]\d*)(?:,Flat)?", text):
        return Factory("graph", links=int(m[1]))
    raise ValueError(f"unknown index: {text}")


# ---------------------------------------------------------------- geometry


def _distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(1)[:, None] - 2 * (q @ c.T) + (c * c).sum(1)[None, :], 0)


def _least(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least of each row, ascending."""
    k = min(k, d.shape[1])
    near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
    return np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(axis=1, kind="stable"), 1)


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most k centroids. They start far from one another; one that loses all its vectors moves to the vector farthest from its own."""
    rng = np.random.default_rng(0)
    k = min(k, len(np.unique(x, axis=0)))
    chosen = [int(rng.integers(len(x)))]
    away = _distances(x, x[chosen])[:, 0]
    while len(chosen) < k:
        total = away.sum()
        chosen.append(int(rng.choice(len(x), p=away / total)) if total > 0 else int(rng.integers(len(x))))
        away = np.minimum(away, _distances(x, x[chosen[-1:]])[:, 0])
    c = x[chosen].copy()
    for _ in range(rounds):
        d = _distances(x, c)
        own = d.argmin(axis=1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        c[empty] = x[np.argsort(-d.min(axis=1), kind="stable")[: len(empty)]]
    return c


@dataclass
class Model:
    """What a search needs beside the stored rows: bounded by cells and code entries, whatever the number of vectors."""

    factory: Factory
    metric: str
    norm: float  # largest squared length, for inner products
    dim: int  # components of a vector as given
    reach: int  # cells or beam width of a search
    recall: float  # as measured on the sample
    centroids: np.ndarray | None = None
    codebooks: np.ndarray | None = None  # (bytes, entries, width)

    def leveled(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Vectors whose distances order as the metric does: for inner products with one more component, 0 in queries."""
        if self.metric != "ip":
            return x
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm - (x * x).sum(1), 0))
        return np.concatenate([x, last[:, None]], axis=1)

    def score(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return q @ x.T if self.metric == "ip" else _distances(q, x)

    def parts(self, x: np.ndarray) -> np.ndarray:
        """(bytes, rows, width) of residuals, filled up with zeros to equal widths."""
        m = self.factory.code_bytes
        width = -(-x.shape[1] // m)
        return np.pad(x, ((0, 0), (0, width * m - x.shape[1]))).reshape(len(x), m, width).transpose(1, 0, 2)

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of leveled vectors."""
        cell = _distances(x, self.centroids).argmin(axis=1)
        if self.codebooks is None:
            return cell, np.zeros((len(x), 0), np.uint8)
        rest = self.parts(x - self.centroids[cell])
        return cell, np.stack([_distances(r, b).argmin(axis=1) for r, b in zip(rest, self.codebooks)], axis=1).astype(np.uint8)

    def by_code(self, q: np.ndarray, cell: int, code: np.ndarray) -> np.ndarray:
        """Distances of leveled queries to the coded vectors of a cell: a sum of table look-ups."""
        rest = self.parts(q - self.centroids[cell])
        out = np.zeros((len(q), len(code)))
        for r, b, c in zip(rest, self.codebooks, code.T):
            out += _distances(r, b)[:, c]
        return out


# ---------------------------------------------------------------- graphs


def links(x: np.ndarray, m: int) -> np.ndarray:
    """Neighbours of each vector in a shard, -1 where there are fewer: its m nearest, the nearest of those that have it among theirs, and a few
    random ones that make every place reachable."""
    n = len(x)
    near = np.full((n, m), -1, np.int32)
    for at in range(0, n, 1024):
        d = _distances(x[at : at + 1024], x)
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        k = min(m, n - 1)
        near[at : at + 1024, :k] = _least(d, k)[:, :k]
    source, target = np.repeat(np.arange(n), m), near.ravel()
    back = np.full((n, m), -1, np.int32)
    known = np.flatnonzero(target >= 0)
    rank = known % m
    order = known[np.lexsort((rank, target[known]))]
    first = np.searchsorted(target[order], target[order])
    place = np.arange(len(order)) - first
    few = place < m
    back[target[order][few], place[few]] = source[order][few]
    ring = (np.arange(n) + 1) % n if n > 1 else np.full(n, -1)
    far = np.random.default_rng(n).integers(0, n, (n, LONG_LINKS))
    return np.concatenate([near, back, ring[:, None], far], axis=1).astype(np.int32)


def beam_search(q: np.ndarray, x: np.ndarray, graph: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the `width` nearest that beams reach, for each query; -1 and infinity where there are fewer."""
    n, at_q = len(x), np.arange(len(q))[:, None]
    entry = np.unique(np.linspace(0, n - 1, min(n, ENTRANCES)).astype(int))
    seen = np.zeros((len(q), n), bool)
    seen[:, entry] = True
    size = (x * x).sum(1)
    ids = np.broadcast_to(entry, (len(q), len(entry))).astype(np.int64)
    d = size[ids] - 2 * (q @ x[entry].T)  # less the query's own square, which orders nothing
    done = np.zeros(ids.shape, bool)
    while True:
        open_ = np.where(done | ~np.isfinite(d), np.inf, d)
        pick = open_.argmin(axis=1)
        live = np.flatnonzero(np.isfinite(open_[np.arange(len(q)), pick]))
        if not len(live):
            break
        done[live, pick[live]] = True
        new = graph[ids[live, pick[live]]]
        fresh = (new >= 0) & ~seen[live[:, None], new]
        order = np.sort(np.where(fresh, new, -1), axis=1)  # a link may stand twice in a row
        order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
        seen[live[:, None], np.maximum(order, 0)] |= order >= 0
        reached = np.where(order >= 0, size[order] - 2 * np.einsum("qd,qmd->qm", q[live], x[order]), np.inf)
        more, far, flag = np.full((len(q), order.shape[1]), -1, np.int64), np.full((len(q), order.shape[1]), np.inf), np.zeros((len(q), order.shape[1]), bool)
        more[live], far[live] = order, reached
        ids, d, done = np.concatenate([ids, more], 1), np.concatenate([d, far], 1), np.concatenate([done, flag], 1)
        keep = _least(d, width)
        ids, d, done = ids[at_q, keep], d[at_q, keep], done[at_q, keep]
    keep = _least(d, width)
    return np.where(np.isfinite(d[at_q, keep]), ids[at_q, keep], -1), d[at_q, keep]


# ---------------------------------------------------------------- fitting


def fitted(x: np.ndarray, spec: Factory, metric: str, norm: float, target: float = TARGET, shard_rows: int = SHARD_ROWS) -> Model:
    """A model of a sample of vectors. Reach grows by a quarter until it finds `target` of the true neighbours of some of them. A graph
    is measured by vectors that are not in it, as a search's are not in most shards: one that is has links to its own neighbours. shard_rows: vectors
    of a graph's shard as it will be built."""
    model = Model(spec, metric, norm, x.shape[1], 0, 1.0)
    if spec.kind == "flat" or not len(x):
        return model
    if spec.kind == "graph":
        mixed = model.leveled(x[np.random.default_rng(1).permutation(len(x))], False)
        n = min(MEASURED, len(x) // 4)
        shard = mixed[n : n + shard_rows]
        q = mixed[:n] if model.metric != "ip" else np.concatenate([mixed[:n, :-1], np.zeros((n, 1))], axis=1)
        k = min(MEASURED_K, len(shard))
        true = _least(_distances(q, shard), k) if n else np.zeros((0, k), int)
        graph = links(shard, spec.links)
        for width in (int(12 * 1.25**p) for p in range(32)):
            found = beam_search(q, shard, graph, max(width, k))[0][:, :k]
            model.reach, model.recall = width, float(np.mean([len(set(t) & set(f)) for t, f in zip(true.tolist(), found.tolist())])) / k if n else 1.0
            if model.recall >= target or width >= len(shard):
                break
        return model
    y, asked = model.leveled(x, False), x[: min(MEASURED, len(x))]
    q = model.leveled(asked, True)
    k = min(MEASURED_K, len(x))
    true = _least(_distances(q, y), k)
    model.centroids = k_means(y, spec.cells)
    if spec.code_bytes:
        cell = _distances(y, model.centroids).argmin(axis=1)
        books = [k_means(r[:CODE_ROWS], ENTRIES, 6) for r in model.parts(y - model.centroids[cell])]
        most = max(map(len, books))
        model.codebooks = np.stack([np.concatenate([b, np.repeat(b[:1], most - len(b), axis=0)]) for b in books])
    cell, code = model.placed(y)
    near = _least(_distances(q, model.centroids), len(model.centroids))
    while model.reach < len(near[0]):
        model.reach = min(max(model.reach + 1, model.reach * 5 // 4), len(near[0]))
        found = []
        for i in range(len(q)):
            rows = np.flatnonzero(np.isin(cell, near[i, : model.reach]))
            if spec.code_bytes:
                coded = np.concatenate([model.by_code(q[i : i + 1], c, code[rows[cell[rows] == c]])[0] for c in np.unique(cell[rows])]) if len(rows) else np.zeros(0)
                rows = np.concatenate([rows[cell[rows] == c] for c in np.unique(cell[rows])])[np.argsort(coded, kind="stable")[: AGAIN * k]] if len(rows) else rows
            found.append(rows[np.argsort(_distances(q[i : i + 1], y[rows])[0], kind="stable")[:k]])
        model.recall = float(np.mean([len(set(t) & set(f)) for t, f in zip(true.tolist(), (f.tolist() for f in found))]) / k)
        if model.recall >= target:
            break
    return model


def _encode(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CODED):
            step = batch.slice(at, CODED)
            cell, code = model.placed(model.leveled(_matrix(step.column("v")), False))
            yield pa.record_batch([pa.array(cell.astype(np.int32)), step.column("pid"), pa.array([c.tobytes() for c in code], pa.binary()), step.column("v")], ["cell", "pid", "code", "v"])


def _shard(key: tuple, table: pa.Table, model: Model) -> pa.Table:
    """The graph of one shard, packed in one row."""
    x = _matrix(table.column("v"))
    graph = links(model.leveled(x, False), model.factory.links)
    pid = table.column("pid").to_numpy().astype("<i8")
    packed = [pid.tobytes(), x.astype("<f8").tobytes(), graph.astype("<i4").tobytes()]
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(pid)], pa.int64())} | {n: pa.array([b], pa.binary()) for n, b in zip(("pids", "vectors", "links"), packed)})


# ---------------------------------------------------------------- search


def _ranked(qid: np.ndarray, best: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    hit = np.isfinite(best[0])
    return pa.record_batch([pa.array(np.repeat(qid, hit.sum(1))), pa.array(best[1][hit]), pa.array(best[0][hit])], ["qid", "pid", "score"])


def _better(best: tuple[np.ndarray, np.ndarray], rows: np.ndarray, score: np.ndarray, pid: np.ndarray, sign: int) -> None:
    """Puts scores and ids into the best lists of some queries; ties go by id."""
    score, pid = np.concatenate([best[0][rows], score], 1), np.concatenate([best[1][rows], np.broadcast_to(pid, score.shape)], 1)
    order = np.lexsort((pid, sign * score), axis=1)[:, : best[0].shape[1]]
    best[0][rows], best[1][rows] = np.take_along_axis(score, order, 1), np.take_along_axis(pid, order, 1)


def _cells(batches: Iterator[pa.RecordBatch], model: Model, qid: np.ndarray, q: np.ndarray, reach: int, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of a partition for each query, from the rows of its nearest cells."""
    sign = -1 if model.metric == "ip" else 1
    asked = model.leveled(q, True)
    near = _least(_distances(asked, model.centroids), reach)
    probes = np.zeros((len(q), len(model.centroids)), bool)
    probes[np.arange(len(q))[:, None], near] = True
    best = np.full((len(q), k), np.inf * sign), np.full((len(q), k), np.iinfo(np.int64).max)
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            step = batch.slice(at, STEP)
            cell, pid = step.column("cell").to_numpy(), step.column("pid").to_numpy()
            x = _matrix(step.column("v"))
            for c in np.unique(cell):
                rows, mine = np.flatnonzero(probes[:, c]), np.flatnonzero(cell == c)
                for part in range(0, len(rows), SCORED):
                    some = rows[part : part + SCORED]
                    if model.codebooks is None or len(mine) <= AGAIN * k:
                        _better(best, some, model.score(q[some], x[mine]), pid[mine], sign)
                        continue
                    code = np.frombuffer(b"".join(step.column("code").take(pa.array(mine)).to_pylist()), np.uint8).reshape(len(mine), -1)
                    again = mine[_least(model.by_code(asked[some], c, code), AGAIN * k)]
                    exact = np.einsum("qd,qmd->qm", q[some], x[again]) if model.metric == "ip" else ((q[some][:, None] - x[again]) ** 2).sum(2)
                    _better(best, some, exact, pid[again], sign)
    yield _ranked(qid, best)


def _beams(batches: Iterator[pa.RecordBatch], model: Model, qid: np.ndarray, q: np.ndarray, reach: int, k: int) -> Iterator[pa.RecordBatch]:
    sign = -1 if model.metric == "ip" else 1
    best = np.full((len(q), k), np.inf * sign), np.full((len(q), k), np.iinfo(np.int64).max)
    asked = model.leveled(q, True)
    for batch in batches:
        for row in batch.to_pylist():
            pid, x = np.frombuffer(row["pids"], "<i8"), np.frombuffer(row["vectors"], "<f8").reshape(row["n"], -1)
            graph, y = np.frombuffer(row["links"], "<i4").reshape(row["n"], -1), model.leveled(x, False)
            for at in range(0, len(q), BEAM_QUERIES):
                some = np.arange(at, min(at + BEAM_QUERIES, len(q)))
                place, _ = beam_search(asked[some], y, graph, max(reach, k))
                place = place[:, :k]
                if model.metric == "ip":
                    exact = np.einsum("qd,qmd->qm", q[some], x[place])
                else:
                    exact = ((q[some][:, None] - x[place]) ** 2).sum(2)
                _better(best, some, np.where(place >= 0, exact, np.inf * sign), np.where(place >= 0, pid[place], np.iinfo(np.int64).max), sign)
    yield _ranked(qid, best)


class VectorIndex:
    """A stored index: `model` on the driver, rows as a table at `path`."""

    def __init__(self, spark: SparkSession, path: str, model: Model):
        self.spark, self.path, self.model = spark, path, model

    @classmethod
    def build(cls, corpus: DataFrame, index: str, metric: str = "ip", path: str | None = None, target: float = TARGET, id_col: str = "vec_id", vector_col: str = "embedding") -> VectorIndex:
        """An index of all rows that have an id and a vector; `path` is in the shared folder where none is given."""
        if metric not in ("ip", "l2"):
            raise ValueError("metric is ip or l2")
        spec, spark = factory(index), corpus.sparkSession
        path = path or new_path(spark, "index")
        rows = corpus.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("pid"), F.col(vector_col).cast("array<double>").alias("v"))
        sample = rows.orderBy(F.xxhash64("pid"), "pid").limit(TRAIN_ROWS).toArrow()
        squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        count, norm = rows.agg(F.count("*"), F.coalesce(F.max(squared), F.lit(0.0))).first()
        shards = max(1, -(-count // SHARD_ROWS))
        model = fitted(_matrix(sample.column("v")), spec, metric, norm, target, -(-count // shards) or 1)
        if spec.kind == "flat" or not count:
            stored = rows
        elif spec.kind == "ivf":
            # A cell may hold a third of all vectors: cells are dealt over several partitions by the rows' hash.
            placed = rows.mapInArrow(partial(_encode, model=model), "cell int, pid long, code binary, v array<double>")
            stored = placed.repartition(F.col("cell"), F.pmod(F.xxhash64("pid"), F.lit(8))).sortWithinPartitions("cell")
        else:
            dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
            stored = dealt.groupBy("shard").applyInArrow(lambda key, table: _shard(key, table, model), "shard long, n long, pids binary, vectors binary, links binary")
        stored.write.parquet(f"{path}/rows")
        about = json.dumps(asdict(spec) | {"metric": metric, "reach": model.reach, "recall": model.recall, "count": count})
        spark.createDataFrame([(about, pickle.dumps(model))], "about string, model binary").coalesce(1).write.parquet(f"{path}/model")
        return cls(spark, path, model)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        return cls(spark, path, pickle.loads(bytes(spark.read.parquet(f"{path}/model").first().model)))

    def vectors(self) -> DataFrame:
        """pid and v of every indexed row."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        if "shard" not in rows.columns:
            return rows.select("pid", "v")
        dim = self.model.dim

        def unpack(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    x = np.frombuffer(r["vectors"], "<f8")
                    yield pa.record_batch([pa.array(np.frombuffer(r["pids"], "<i8")), pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, dim), pa.int32()), pa.array(x))], ["pid", "v"])

        return rows.mapInArrow(unpack, "pid long, v array<double>")

    def search(self, queries: DataFrame, k: int, reach: int | None = None, exact: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """qid, pid, score, rank: the k best that the index finds for each query. reach: cells or beam width, else as fitted."""
        model, rows = self.model, self.spark.read.parquet(f"{self.path}/rows")
        asked = queries.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("qid"), F.col(vector_col).cast("array<double>").alias("v"))
        if exact or model.factory.kind == "flat" or "pid" in rows.columns and "cell" not in rows.columns:
            return knn(asked.withColumnsRenamed({"qid": id_col, "v": vector_col}), self.vectors().withColumnsRenamed({"pid": id_col, "v": vector_col}), k, model.metric, id_col, vector_col)
        reach = reach or model.reach
        scan = _cells if model.factory.kind == "ivf" else _beams

        def run(block: pa.Table) -> DataFrame:
            q = _matrix(block.column("v"))
            most = min(reach, len(model.centroids)) if scan is _cells else reach
            found = partial(scan, model=model, qid=block.column("qid").to_numpy(), q=q, reach=most, k=k)
            some = rows
            if scan is _cells:  # cells that no query of the block is near are not read
                near = np.unique(_least(_distances(model.leveled(q, True), model.centroids), most))
                some = rows.where(F.col("cell").isin(*near.tolist())) if len(near) < len(model.centroids) else rows
            return some.mapInArrow(found, _HITS)

        return merge_top(_in_blocks(asked, "qid", asked.count(), BLOCK, run), k, ascending=model.metric == "l2")


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """queries, hits, share: how many of the true hits (qid, pid) are among those found."""
    mark = found.select("qid", "pid", F.lit(1).alias("_found"))
    both = true.select("qid", "pid").join(mark, ["qid", "pid"], "left")
    return both.agg(F.countDistinct("qid").alias("queries"), F.count("*").alias("hits"), (F.coalesce(F.sum("_found"), F.lit(0)) / F.count("*")).alias("share"))
