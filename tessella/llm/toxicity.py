"""Toxicity: a convolutional text classifier over hashed words, trained in numpy inside Spark tasks.

Words (runs of letters and digits, A-Z lowered) and their first few bytes are hashed into buckets. A word's vector is the sum of its
buckets' embeddings, so that inflected words are known by their stems. Filters of several widths slide over
the text, and each filter's largest value over the whole text feeds a logistic output. The score is a
function of the text alone. Its scale is calibrated so that 0.5 decides best on labelled rows that the network has not seen;
thresholds of each language, found on the same rows, give `flagged`.

Every labelled text that is not held out is learned from or calibrates. Texts are dealt by hash; in each pass a task walks through what it reads from the
network of the pass before, and the tasks' changes are averaged, slice by slice of the parameters. Counts of buckets and of calibrating logits are
Spark aggregates over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import NOT_ALNUM, STEP_BYTES, SlotFilter, Words, buffers, give_back, mapped, mix, steps, stored

#: Buckets of hashed words, components of an embedding, widths of the filters and filters of each width.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 16, (1, 2, 3), 8
#: Lengths in bytes of the stems that are hashed beside a longer word itself.
STEMS = (4, 5, 6, 7, 8)
#: Empty words after each text, so that no filter reaches from one text into the next.
PAD = max(WIDTHS) - 1
#: Share of either label in training, for which the rarer label's texts are repeated. Bytes of text that a task learns from at once.
LEAST_SHARE, CHUNK_BYTES = 0.05, 4 << 20
#: Texts of a label that a task keeps for chunks that have none of it.
KEPT = 64
#: Rows of embeddings whose changes are one row of a table.
SLICE = 1024
#: Calibrating logits are counted in bins of 1 / BINS from -REACH to REACH.
BINS, REACH = 1024, 32
#: A bucket with fewer texts has no embedding: nothing can be learned of it.
LEAST_TEXTS = 10
#: Passes, texts of a step, rate, share of words left out at random, weight decay, and the seed of it all.
EPOCHS, TEXTS, RATE, DROPPED, DECAY, SEED = 4, 64, 0.08, 0.3, 1e-4, 17
#: One labelled id in so many calibrates; toxic texts of those that outweigh the common threshold in a language's own.
CALIBRATION, LEAST_TOXIC = 4, 20
#: Bits of a 64-bit hash above its bucket.
SHIFT = np.uint64(64 - (BUCKETS - 1).bit_length())
#: Words that are convolved at once, in scoring and in learning.
RUN, LEARN_RUN = 1 << 12, 1 << 16


@dataclass
class Bags:
    """Texts as places in a table of their different words; row 0 of the table is the empty word."""

    table: np.ndarray  # buckets of each word and of its stems, -1 for a stem that the word has not
    places: np.ndarray
    bound: np.ndarray  # words of text i: bound[i] to bound[i + 1]

    def only(self, texts: np.ndarray) -> Bags:
        parts = [self.places[self.bound[i] : self.bound[i + 1]] for i in texts]
        return Bags(self.table, np.concatenate([*parts, self.places[:0]]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(int))

    def padded(self) -> tuple[np.ndarray, np.ndarray]:
        """Places with PAD empty words after each text, and the text of each (-1 in the padding)."""
        n = np.diff(self.bound)
        at = np.arange(len(self.places)) + PAD * np.repeat(np.arange(len(n)), n)
        ids, text = np.zeros(len(at) + PAD * len(n), np.int32), np.full(len(at) + PAD * len(n), -1, np.int32)
        ids[at], text[at] = self.places, np.repeat(np.arange(len(n), dtype=np.int32), n)
        return ids, text


def bags(texts: pa.Array) -> Bags:
    words = Words(*buffers(texts), NOT_ALNUM, fold=True)
    different, first, places = np.unique(words.hashes(), return_index=True, return_inverse=True)
    start, length = words.start[first], (words.end - words.start)[first]
    table = np.full((len(different) + 1, 1 + len(STEMS)), -1, np.int32)
    table[1:, 0] = different >> SHIFT
    stem = np.zeros(len(different), np.uint64)
    for k in range(max(STEMS)):
        has = np.flatnonzero(length > k)
        stem[has] = mix(stem[has] * np.uint64(257) + words.data[start[has] + k] + np.uint64(1))
        if k + 1 in STEMS:
            longer = length > k + 1
            table[1:][longer, 1 + STEMS.index(k + 1)] = stem[longer] >> SHIFT
    return Bags(table, (places + 1).astype(np.int32), words.bound)


@dataclass
class Network:
    slot: np.ndarray  # bucket -> row of embeddings; row 0, of all buckets that are too rare, is zero
    embeddings: np.ndarray
    filters: list[np.ndarray]  # of each width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray  # one number

    def rows(self, table: np.ndarray) -> np.ndarray:
        """Rows of embeddings of each word of a table."""
        return np.where(table >= 0, self.slot[table], 0)

    def convolved(self, x: np.ndarray) -> list[np.ndarray]:
        """Every filter at every place of the word vectors x but the last PAD, by width."""
        n = len(x) - PAD
        kernel = np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)
        y, at, found = x @ kernel, 0, []
        for f in self.filters:
            z = y[:n, at : at + FILTERS].copy()
            for j in range(1, len(f)):
                z += y[j : n + j, at + j * FILTERS : at + (j + 1) * FILTERS]
            at += len(f) * FILTERS
            found.append(z)
        return found

    def pooled(self, texts: Bags) -> np.ndarray:
        """The largest value of each filter over each whole text; 0 for a text without words or a filter that finds nothing."""
        vectors = self.embeddings[self.rows(texts.table)].sum(axis=1)
        ids, text = texts.padded()
        most = np.full((len(texts.bound) - 1, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        for at in range(0, len(ids), RUN):
            here = text[at : at + RUN]
            inside = here >= 0
            if not inside.any():
                continue
            run = np.zeros(len(here) + PAD, np.int32)
            run[: len(ids[at : at + RUN + PAD])] = ids[at : at + RUN + PAD]
            z, owner = np.concatenate(self.convolved(vectors[run]), axis=1)[inside], here[inside]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            most[owner[first]] = np.maximum(most[owner[first]], np.maximum.reduceat(z, first, axis=0))
        return np.maximum(most + self.bias, 0)

    def logits(self, texts: Bags) -> np.ndarray:
        return self.pooled(texts).astype(float) @ self.out.astype(float) + self.out_bias


def counted(texts: Bags, y: np.ndarray) -> np.ndarray:
    """How many texts of each label have each bucket; behind the buckets, the number of texts."""
    seen = np.zeros((2, BUCKETS + 1), np.int64)
    for i, label in enumerate(y):
        seen[label, np.unique(texts.table[texts.places[texts.bound[i] : texts.bound[i + 1]]])] += 1
    seen[:, BUCKETS] = np.bincount(y, minlength=2)
    return seen


def started(seen: np.ndarray, rng: np.random.Generator) -> Network:
    """A random network over the buckets that enough texts have. One component of an embedding starts as the damped log odds of its bucket."""
    known = np.flatnonzero(seen[:, :BUCKETS].sum(axis=0) >= LEAST_TEXTS)
    slot = np.zeros(BUCKETS, np.int32)
    slot[known] = np.arange(1, len(known) + 1)
    embeddings = rng.normal(0, 0.5 / np.sqrt(DIM), (len(known) + 1, DIM)).astype(np.float32)
    share = (seen[:, known] + 2) / (seen[:, BUCKETS:] + 4)
    embeddings[1:, 0] = np.clip(np.log(share[1] / share[0]), -2, 2)
    embeddings[0] = 0
    filters = [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    return Network(slot, embeddings, filters, np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), np.zeros(1))


def parameters(net: Network) -> list[np.ndarray]:
    return [net.embeddings, *net.filters, net.bias, net.out, net.out_bias]


def no_past(net: Network) -> list[np.ndarray]:
    """Sums of squared gradients before the first step; a row of embeddings has one, of its components' mean."""
    return [np.full((len(net.embeddings), 1), 0.01, np.float32), *(np.full_like(p, 0.01) for p in parameters(net)[1:])]


def trained(texts: Bags, y: np.ndarray, epochs: int = EPOCHS) -> Network:
    """A network for texts and labels that one machine holds."""
    rng = np.random.default_rng(SEED)
    net = started(counted(texts, y), rng)
    past = no_past(net)
    for _ in range(epochs):
        learn(net, past, texts, y, rng)
    return net


def learn(net: Network, past: list[np.ndarray], texts: Bags, y: np.ndarray, rng: np.random.Generator) -> None:
    """One pass over texts and labels. Each step takes as many texts of either label; each parameter's rate is scaled by its own
    gradients so far."""
    table = net.rows(texts.table)
    of = [o for o in (np.flatnonzero(y == k) for k in (0, 1)) if len(o)]

    def step(k: int, p: np.ndarray, gradient: np.ndarray, rows=slice(None)) -> None:
        past[k][rows] += gradient * gradient if k else (gradient * gradient).mean(axis=1, keepdims=True)
        p[rows] -= RATE * gradient / np.sqrt(past[k][rows])

    order = [rng.permutation(np.resize(rng.permutation(o), max(map(len, of)))) for o in of]
    for at in range(0, len(order[0]), TEXTS // 2):
        chosen, times = np.unique(np.concatenate([o[at : at + TEXTS // 2] for o in order]), return_counts=True)
        batch = texts.only(chosen)
        if not len(batch.places):
            continue
        ids, text = batch.padded()
        ids[rng.random(len(ids)) < DROPPED] = 0
        ids = np.append(ids, np.zeros(PAD, np.int32))
        here, place = np.unique(ids, return_inverse=True)
        vectors = net.embeddings[table[here]].sum(axis=1)
        ends = batch.bound + PAD * np.arange(len(batch.bound))
        places, most = np.repeat(ends[:-1, None], len(net.bias), axis=1), np.full((len(chosen), len(net.bias)), -np.inf, np.float32)
        for low in range(0, len(text), LEARN_RUN):
            z = np.concatenate(net.convolved(vectors[place[low : low + LEARN_RUN + PAD]]), axis=1)
            z[text[low : low + len(z)] < 0] = -np.inf
            first, last = np.maximum(ends[:-1] - low, 0), np.minimum(ends[1:] - low, len(z))
            for i in np.flatnonzero(first < last):
                best = first[i] + z[first[i] : last[i]].argmax(axis=0)
                value = z[best, np.arange(z.shape[1])]
                better = value > most[i]
                most[i, better], places[i, better] = value[better], low + best[better]
        raw = most + net.bias
        h = np.where(np.isfinite(raw), np.maximum(raw, 0), 0)
        p = 1 / (1 + np.exp(-np.clip(h @ net.out + net.out_bias, -30, 30)))
        wrong = (times * (p - y[chosen]) / times.sum()).astype(np.float32)
        back = wrong[:, None] * net.out * (h > 0)
        words, moved = [], []
        for w, f in enumerate(net.filters):
            g, gradient = back[:, w * FILTERS : (w + 1) * FILTERS], np.empty_like(f)
            for j in range(len(f)):
                at_j = place[places[:, w * FILTERS : (w + 1) * FILTERS] + j]
                gradient[j] = np.einsum("bk,bkd->dk", g, vectors[at_j])
                words.append(at_j.ravel())
                moved.append((g[:, :, None] * f[j].T).reshape(-1, DIM))
            step(1 + w, f, gradient + DECAY * f)
        by_word = np.zeros((len(here), DIM), np.float32)
        np.add.at(by_word, np.concatenate(words), np.concatenate(moved))
        touched = np.flatnonzero(by_word.any(axis=1))
        rows, which = np.unique(table[here[touched]], return_inverse=True)
        gradient = np.zeros((len(rows), DIM), np.float32)
        np.add.at(gradient, which.ravel(), np.repeat(by_word[touched], table.shape[1], axis=0))
        gradient[rows == 0] = 0
        step(0, net.embeddings, gradient, rows)
        step(len(past) - 3, net.bias, back.sum(axis=0))
        step(len(past) - 2, net.out, h.T.astype(np.float32) @ wrong + DECAY * net.out)
        step(len(past) - 1, net.out_bias, wrong.sum(keepdims=True).astype(float))


def best_threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the best F1; of equals the widest gap, in its middle."""
    order = np.argsort(-z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    right = np.cumsum(weight * y)
    f1 = 2 * right / (np.cumsum(weight) + (weight * y).sum())
    below = np.append(z[1:], z[-1] - 1)
    gap = z - below
    f1[gap <= 0] = -1  # equal values are one side's
    k = np.lexsort((gap, f1))[-1]
    return float((z[k] + below[k]) / 2)


@dataclass
class Classifier:
    network: Network
    threshold: float  # logit that becomes 0.5
    slope: float
    languages: dict[str, float]  # score from which a language's texts are flagged

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = self.network.logits(bags(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * (z - self.threshold), -30, 30)))


def calibrated(network: Network, z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Classifier:
    """Threshold and slope from logits of texts that the network has not seen."""
    cut = best_threshold(z, y, weight)
    slope = 1.0
    for _ in range(50):  # logistic slope around the cut, held to what separable texts still determine
        p = 1 / (1 + np.exp(-np.clip(slope * (z - cut), -30, 30)))
        d = z - cut
        change = (weight * d * (y - p)).sum() - 0.01 * weight.sum() * (slope - 1)
        slope = float(np.clip(slope + change / ((weight * d * d * p * (1 - p)).sum() + 0.01 * weight.sum()), 0.2, 5.0))
    return Classifier(network, cut, slope, {})


def held_out(doc_id: Column) -> Column:
    """Whether a row's label may not be learned from: crc32 of the id as text is a multiple of 5. False without an id; such rows have no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((2, BUCKETS + 1), np.int64)
    for batch in batches:
        for step in steps(batch, most=STEP_BYTES):
            seen += counted(bags(step.column("text")), step.column("toxic").to_numpy())
    at = np.flatnonzero(seen.any(axis=0))
    yield pa.record_batch([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], ["bucket", "clean", "toxic"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """texts, labels: runs of a task's texts with about CHUNK_BYTES, both labels in each as soon as the task has seen both."""
    texts, labels, size, kept = [], [], 0, {}

    def chunk() -> tuple[pa.Array, np.ndarray]:
        text, y = pa.concat_arrays(texts), np.concatenate(labels)
        for k in (0, 1):
            if (y == k).any():
                kept[k] = text.take(pa.array(np.flatnonzero(y == k)[-KEPT:]))
            elif k in kept:
                text, y = pa.concat_arrays([text, kept[k]]), np.append(y, np.full(len(kept[k]), k, y.dtype))
        return text, y

    for batch in batches:
        for step in steps(batch, most=STEP_BYTES):
            if size >= CHUNK_BYTES:
                yield chunk()
                texts, labels, size = [], [], 0
            texts.append(step.column("text").cast(pa.large_string()))
            labels.append(step.column("toxic").to_numpy())
            size += step.column("text").nbytes
    if texts:
        yield chunk()


def _flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays]).astype(np.float32)


def _changes(batches: Iterator[pa.RecordBatch], model, epoch: int) -> Iterator[pa.RecordBatch]:
    """task, slice, rows, values: how a task's pass changes the rows of embeddings that it touches, with their past; slice -1 has all else."""
    task = TaskContext.get().partitionId()
    start, past0 = model.value

    net, past, rng, any_text = deepcopy(start), deepcopy(past0), np.random.default_rng([SEED, epoch, task]), False
    for text, y in _chunks(batches):
        any_text = True
        learn(net, past, bags(text), y, rng)
    if any_text:
        schema = pa.schema({"task": pa.int32(), "slice": pa.int32(), "rows": pa.binary(), "values": pa.binary()})
        rest = _flat(parameters(net)[1:] + past[1:]) - _flat(parameters(start)[1:] + past0[1:])
        yield pa.RecordBatch.from_pylist([{"task": task, "slice": -1, "rows": np.zeros(1, np.int32).tobytes(), "values": rest.tobytes()}], schema)
        for at in range(0, len(net.embeddings), SLICE):
            values = np.concatenate([(new[at : at + SLICE] - old[at : at + SLICE]) for new, old in ((net.embeddings, start.embeddings), (past[0], past0[0]))], axis=1)
            rows = np.flatnonzero(values.any(axis=1)).astype(np.int32)
            if len(rows):
                yield pa.RecordBatch.from_pylist([{"task": task, "slice": at // SLICE, "rows": rows.tobytes(), "values": values[rows].astype(np.float16).tobytes()}], schema)


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """slice, rows, values of changes that come slice after slice: each row's mean over the tasks that touch it."""
    here, total, times = None, None, None

    def made() -> pa.RecordBatch:
        rows = np.flatnonzero(times)
        return pa.record_batch([pa.array([here], pa.int32()), pa.array([rows.astype(np.int32).tobytes()], pa.binary()), pa.array([(total[rows] / times[rows, None]).astype(np.float32).tobytes()], pa.binary())], ["slice", "rows", "values"])

    for batch in batches:
        for k, rows, values in zip(batch.column("slice").to_pylist(), batch.column("rows"), batch.column("values")):
            rows = np.frombuffer(rows.as_buffer(), np.int32)
            values = np.frombuffer(values.as_buffer(), np.float16 if k >= 0 else np.float32).reshape(len(rows), -1)
            if k != here:
                if here is not None:
                    yield made()
                here, total, times = k, np.zeros((SLICE if k >= 0 else 1, values.shape[1])), np.zeros(SLICE if k >= 0 else 1)
            total[rows] += values
            times[rows] += 1
    if here is not None:
        yield made()


def _moved(net: Network, past: list[np.ndarray], changes: pa.Table) -> None:
    for k, rows, values in zip(changes.column("slice").to_pylist(), changes.column("rows"), changes.column("values")):
        rows = np.frombuffer(rows.as_buffer(), np.int32)
        values = np.frombuffer(values.as_buffer(), np.float32).reshape(len(rows), -1)
        if k >= 0:
            net.embeddings[k * SLICE + rows] += values[:, :DIM]
            past[0][k * SLICE + rows] += values[:, DIM:]
        else:
            at = 0
            for p in parameters(net)[1:] + past[1:]:
                p += values[0, at : at + p.size].reshape(p.shape).astype(p.dtype)
                at += p.size


def network_of(parts: DataFrame) -> Network:
    """A network from copy, toxic, text, a file of rows in the order of learning for each task or several. Its parameters are all that reaches the driver."""
    spark = parts.sparkSession
    counts = mapped(parts.where("copy = 0").select("toxic", "text"), _counts, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = counts.where((F.col("clean") + F.col("toxic") >= LEAST_TEXTS) | (F.col("bucket") == BUCKETS)).toArrow()  # a row for each bucket at most
    seen = np.zeros((2, BUCKETS + 1), np.int64)
    seen[:, counts.column("bucket").to_numpy()] = [counts.column("clean").to_numpy(), counts.column("toxic").to_numpy()]
    net = started(seen, np.random.default_rng(SEED))
    past = no_past(net)
    for epoch in range(EPOCHS):
        shared = spark.sparkContext.broadcast((net, past))
        changes = mapped(parts.select("toxic", "text"), partial(_changes, model=shared, epoch=epoch), "task int, slice int, rows binary, values binary")
        means = mapped(changes.repartition("slice").sortWithinPartitions("slice", "task").select("slice", "rows", "values"), _means, "slice int, rows binary, values binary")
        _moved(net, past, means.toArrow())
        shared.destroy()
        give_back()
    return net


def _logit_bins(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for step in steps(batch, most=STEP_BYTES):
            bins = np.rint(np.clip(model.value.logits(bags(step.column("text"))), -REACH, REACH) * BINS).astype(np.int32)
            kept = [c for c in step.schema.names if c != "text"]
            yield pa.record_batch([*(step.column(c) for c in kept), pa.array(bins)], [*kept, "bin"])


def _own_threshold(bins: pd.DataFrame, weight: list[float], cut: float, slope: float) -> pd.DataFrame:
    """A language's own threshold, which counts for as much as its toxic texts against LEAST_TOXIC at the common one; none without texts of both labels."""
    z, y, n = bins.bin.to_numpy() / BINS, bins.toxic.to_numpy(), bins.n.to_numpy()
    toxic = int(n[y == 1].sum())
    if not toxic or toxic == n.sum():
        return pd.DataFrame({"lang": pd.Series([], dtype=object), "threshold": pd.Series([], dtype=float)})
    at = (toxic * best_threshold(z, y, n * np.take(weight, y)) + LEAST_TOXIC * cut) / (toxic + LEAST_TOXIC)
    return pd.DataFrame({"lang": [bins.lang.iloc[0]], "threshold": [float(1 / (1 + np.exp(-np.clip(slope * (at - cut), -30, 30))))]})


def train(docs: DataFrame, labels: DataFrame) -> Classifier | float:
    """A classifier from all labelled texts that are not held out: three ids in CALIBRATION train the network, the others calibrate it. The share of toxic
    labels where either label or either side has no texts (0 without labels)."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    known = stored(known.withColumn("apart", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(CALIBRATION)) == 0), "toxicity-labels")
    total = dict.fromkeys((0, 1), 0) | {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = total[1] / max(1, sum(total.values()))
    if not total[0] or not total[1]:
        return share
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    sizes = {(r.apart, r.toxic): r["count"] for r in texts.select("doc_id").join(known, "doc_id").groupBy("apart", "toxic").count().collect()}
    if len(sizes) < 4:
        return share
    n = [sizes[False, k] for k in (0, 1)]
    copies = [max(1, int(LEAST_SHARE * n[1 - k] / n[k])) for k in (0, 1)]
    # Texts that may have a label are shuffled once, labels to them.
    texts = SlotFilter(known, "doc_id").keep(texts, "doc_id")
    dealt = texts.join(known.hint("merge"), "doc_id").withColumn("key", F.xxhash64("doc_id", "text")).dropDuplicates(["doc_id", "key"])
    dealt = dealt.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("apart"), 0).when(F.col("toxic") == 1, copies[1] - 1).otherwise(copies[0] - 1))))
    dealt = dealt.select("apart", F.xxhash64("key", "copy").alias("order"), "key", "copy", "toxic", "lang", "text")
    dealt = stored(dealt.sortWithinPartitions("apart", "order", "key"), "toxicity-parts")
    network = network_of(dealt.where("not apart"))
    shared = spark.sparkContext.broadcast(network)
    bins = mapped(dealt.where("apart").select("toxic", "lang", "text"), partial(_logit_bins, model=shared), "toxic int, lang string, bin int")
    bins = stored(bins.groupBy("lang", "bin", "toxic").agg(F.count("*").alias("n")), "toxicity-logits")
    shared.destroy()
    every = bins.groupBy("bin", "toxic").agg(F.sum("n").alias("n")).toArrow()  # two rows a bin at most
    z, y, n = (every.column(c).to_numpy() for c in ("bin", "toxic", "n"))
    weight = np.array([total[k] / n[y == k].sum() for k in (0, 1)])
    weight /= (n * weight[y]).sum() / n.sum()
    classifier = calibrated(network, z / BINS, y, n * weight[y])
    given = weight.tolist(), classifier.threshold, classifier.slope
    own = bins.where("lang is not null").groupBy("lang").applyInPandas(lambda pdf: _own_threshold(pdf, *given), "lang string, threshold double")
    classifier.languages.update((r.lang, r.threshold) for r in own.orderBy("lang").collect())
    return classifier


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    classifier = model.value
    for batch in batches:
        for step in steps(batch, most=STEP_BYTES):
            kept = [c for c in step.schema.names if c != "text"]
            yield pa.record_batch([*(step.column(c) for c in kept), pa.array(classifier.scores(step.column("text")))], [*kept, "score"])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, lang, lang_threshold, flagged: one row for each document row.

    Score hangs on the text alone: 0 to 1, the same for empty and null texts. predicted is 1 from 0.5 on. flagged is score >= lang_threshold, that of the
    row's language (0.5 for languages that the labels cannot tell, or null). Labels of an id that contradict each other, or other than 0 and 1, are left out;
    repeated rows count once in training. Without labels of both kinds every score is their share of toxic ones. Other columns are
    ignored; no rows give no rows.
    """
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    model = train(docs, labels)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    if isinstance(model, float):
        scored, own = base.select("doc_id", "lang", F.lit(model).alias("score")), {}
    else:
        shared, own = docs.sparkSession.sparkContext.broadcast(model), model.languages
        give_back()
        scored = mapped(base, lambda b: _scored(b, shared), "doc_id long, lang string, score double")
    threshold = F.lit(0.5)
    for lang, at in own.items():
        threshold = F.when(F.col("lang") == lang, F.lit(at)).otherwise(threshold)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "lang", threshold.alias("lang_threshold"), (F.col("score") >= threshold).alias("flagged"))
