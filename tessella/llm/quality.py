"""Quality classifier: hierarchical empirical Bayes over document, path and host.

A logistic model gives each document's evidence, from surface counts and from two naive-Bayes scores on hashed word and character
n-grams (the labelled documents are scored with the counts of those in the other fold). Its means by host and by path within
host, as grouped sums, become posteriors that shrink to the level above with a strength that the spread between groups
sets (method of moments), so a sparse site counts for little. A document's log odds are its own plus how far its path's
posterior is from the global prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ASCII_SPACE, FOLD, ROW, Words, buffers, give_back, keyed, mapped, steps, stored

FEATURES = ("upper", "digit", "symbol", "shout", "bar", "repeat", "few_distinct", "word_length", "log_words", "long_words")
LOG_WORDS = FEATURES.index("log_words")
#: Bytes of text that are looked at together.
FEATURE_BYTES = 1 << 18
#: Buckets of hashed words and of hashed runs of CHARS bytes.
WORD_BUCKETS, CHAR_BUCKETS, CHARS = 1 << 16, 1 << 14, 4
#: Labelled rows that the classifier is fitted on at most, chosen by hash.
TRAIN_ROWS = 50_000
#: Documents with a posterior below are rejected.
THRESHOLD = 0.5
#: Bounds of the shrinkage strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 5.0, 1000.0


def _classes() -> np.ndarray:
    out = np.zeros((6, 256), np.uint8)
    out[0, 65:91] = 1
    out[1, 48:58] = 1
    out[2, [ord(c) for c in "#$%&*"]] = 1
    out[3, ord("!")] = 1
    out[4, ord("|")] = 1
    out[5, 97:123] = 1
    return out


_CLASSES = _classes()


class Grams:
    """Words of a run of texts, and buckets of their words and character n-grams."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = data, offsets = buffers(column)
        self.words = Words(data, offsets, ASCII_SPACE)
        self.hashes = self.words.hashes()
        self.word = (self.hashes >> np.uint64(48)).astype(np.uint16)  # 16 bits
        n = max(0, len(data) - CHARS + 1)
        code = np.zeros(n, np.uint32)
        for k in range(CHARS):
            code <<= np.uint32(8)
            code |= FOLD[data[k : k + n]]
        code *= np.uint32(0x9E3779B1)
        code >>= np.uint32(18)  # 14 bits
        self.char = code.astype(np.uint16)
        across = np.unique((offsets[1:-1, None] - np.arange(1, CHARS)).ravel())  # n-grams that begin in one text and end in another
        self.across = across[(across >= 0) & (across < n)]
        self.length = np.minimum(offsets, n)

    def scores(self, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Mean log ratio of a text's words and of its n-grams; 0 for a text without any."""
        out = []
        for bucket, bound, table, none in ((self.word, self.words.bound, tables[0], np.zeros(0, np.int64)), (self.char, self.length, tables[1], self.across)):
            value = table[bucket]
            value[none] = 0
            total = np.concatenate([[0.0], np.cumsum(value)])
            n = np.diff(bound) - np.bincount(np.searchsorted(bound, none, "right") - 1, minlength=len(bound) - 1)[: len(bound) - 1]
            out.append((total[bound[1:]] - total[bound[:-1]]) / np.maximum(n, 1))
        return np.stack(out, axis=1)

    def present(self) -> tuple[np.ndarray, np.ndarray]:
        """Each text's different buckets, those of n-grams after those of words, and the texts."""
        whole = np.ones(len(self.char), bool)
        whole[self.across] = False
        text = np.repeat(np.arange(len(self.length) - 1), np.diff(self.length))[whole]
        both = [(self.words.text, self.word, 0), (text, self.char[whole], WORD_BUCKETS)]
        keys = np.concatenate([_unique(t, bucket) + first for t, bucket, first in both])
        return keys & 0xFFFFFFFF, keys >> 32


def _unique(text: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Pairs of a text and a 16-bit bucket, each once, as text * 2^32 + bucket. Few texts make keys that sort fast."""
    kind = np.uint32 if len(text) == 0 or int(text[-1]) < 1 << 16 else np.int64
    found = np.unique(text.astype(kind) << kind(16) | bucket).astype(np.int64)
    return (found >> 16) << 32 | found & 0xFFFF


def log_ratios(seen: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """seen: for label 0 and 1, the texts that have each bucket; texts: all of each label. Smoothed log ratios of words and n-grams."""
    share = np.log((seen + 1.0) / (texts[:, None] + 2.0))
    ratio = share[1] - share[0]
    return ratio[:WORD_BUCKETS], ratio[WORD_BUCKETS:]


def features(grams: Grams) -> np.ndarray:
    """A row of FEATURES for each text; a text without words has zeros."""
    data, offsets, words = grams.data, grams.offsets, grams.words
    h, n = grams.hashes, words.count
    total = np.zeros((len(offsets) - 1, 6))
    for k in range(6):
        total[:, k] = np.diff(np.concatenate([[0], np.cumsum(_CLASSES[k][data], dtype=np.int64)])[offsets])
    letters, size = np.maximum(total[:, 0] + total[:, 5], 1), np.maximum(np.diff(offsets), 1)

    def by_text(mask: np.ndarray) -> np.ndarray:
        return np.bincount(words.text[mask], minlength=len(n))

    repeat = np.zeros(len(h), bool)
    repeat[1:] = (h[1:] == h[:-1]) & (words.text[1:] == words.text[:-1])
    pair = np.sort(words.text.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
    pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
    distinct = np.bincount((pair >> np.uint64(40)).astype(np.int64), minlength=len(n))
    most = np.maximum(n, 1)
    out = np.stack([total[:, 0] / letters, total[:, 1] / size, total[:, 2] / size, total[:, 3] / size, total[:, 4] / size, by_text(repeat) / most, 1 - np.minimum(1, distinct / np.maximum(1, most**0.8)), size / most / 10, np.log1p(n) / 10, by_text(words.end - words.start > 24) / most], axis=1)
    out[n == 0] = 0
    return out


def _design(x: np.ndarray) -> np.ndarray:
    """Features with their square roots: most of the signal is in whether a share is zero."""
    return np.concatenate([np.ones((len(x), 1)), x, np.sqrt(np.maximum(x, 0))], axis=1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray | None:
    """Logistic weights by Newton steps; None unless both classes are there."""
    if len(set(y.tolist())) < 2:
        return None
    d = _design(x)
    w = np.zeros(d.shape[1])
    penalty = np.full(len(w), ridge * np.sqrt(len(y)))
    penalty[0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p) + 1e-9)[:, None]).T @ d + np.diag(penalty), d.T @ (y - p) - penalty * w)
        w += np.clip(step, -10, 10)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    tables: tuple[np.ndarray, np.ndarray]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(x) @ self.weights, -30, 30)))


def _evidence(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for step in steps(batch, most=FEATURE_BYTES):
            grams = Grams(step.column("text"))
            x = np.concatenate([features(grams), grams.scores(model.tables)], axis=1)
            keys = [c for c in step.schema.names if c != "text"]
            yield pa.record_batch([*(step.column(c) for c in keys), pa.array(model.probability(x), mask=x[:, LOG_WORDS] == 0)], [*keys, "p"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets by fold and label, with the number of texts that have each; bucket -1 counts the texts."""
    for batch in batches:
        for step in steps(batch, most=FEATURE_BYTES):
            group = step.column("fold").to_numpy() * 2 + step.column("quality").to_numpy()
            bucket, text = Grams(step.column("text")).present()
            key, n = np.unique(np.concatenate([group[text].astype(np.int64) << 32 | bucket + 1, group.astype(np.int64) << 32]), return_counts=True)
            yield pa.record_batch([pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32) - 1), pa.array(n)], ["cell", "bucket", "n"])


def _featured(batches: Iterator[pa.RecordBatch], tables: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Features of labelled texts, with the scores by the counts of the other fold."""
    for batch in batches:
        for step in steps(batch, most=FEATURE_BYTES):
            grams, fold = Grams(step.column("text")), step.column("fold").to_numpy()
            scores = np.where(fold[:, None] == 0, grams.scores(tables[1]), grams.scores(tables[0]))
            x = np.concatenate([features(grams), scores], axis=1)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
            yield pa.record_batch([rows, step.column("quality")], ["x", "quality"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """A model of at most `rows` labelled documents; rows without an id, a text or a label of 0 or 1 are left out, and of rows that share an
    id the one that stands first in the table is taken. None unless both labels are there."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = (docs if ROW in docs.columns else keyed(docs)).where("doc_id is not null and text is not null")
    first = texts.select("doc_id", ROW).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(ROW).alias(ROW), F.first("quality").alias("quality"))  # at most `rows`, as `chosen` has
    found = texts.select(ROW, "text").join(F.broadcast(first), ROW)
    found = stored(found.select("text", "quality", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold")), "quality-labelled")
    counts = mapped(found, _counted, "cell int, bucket int, n long").groupBy("cell", "bucket").agg(F.sum("n").alias("n")).toArrow()  # a row for each cell and bucket at most
    seen = np.zeros((4, WORD_BUCKETS + CHAR_BUCKETS + 1))
    seen[counts.column("cell").to_numpy(), counts.column("bucket").to_numpy() + 1] = counts.column("n").to_numpy()
    texts, seen = seen[:, 0], seen[:, 1:]
    if not (texts[[0, 2]].any() and texts[[1, 3]].any()):
        return None
    tables = [log_ratios(seen[2 * k : 2 * k + 2], texts[2 * k : 2 * k + 2]) for k in (0, 1)]
    table = mapped(found, lambda b: _featured(b, tables), "x array<double>, quality int").toArrow()
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    weights = fit(x, table.column("quality").to_numpy().astype(float))
    del table, x, counts
    give_back()
    return None if weights is None else Model(weights, log_ratios(seen[:2] + seen[2:], texts[:2] + texts[2:]))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, prior: Column) -> Column:
    """Documents that the level above counts for: large where groups are alike. An aggregate over groups (n, s, w)."""
    spread = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - prior, 2)) / F.sum("n")
    noise = F.sum(F.col("w")) / F.sum("n")  # variance of one document around its group's mean
    excess = spread - noise * F.count("*") / F.sum("n")
    return F.least(F.lit(MOST_STRENGTH), F.greatest(F.lit(LEAST_STRENGTH), F.coalesce(F.when(excess > 0, noise / excess), F.lit(MOST_STRENGTH))))


def quality_posteriors(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, posterior, accepted: one row for each document row.

    Host and path are columns that say where a document is from; where a corpus has no URLs, its language can stand for the path, as the
    defaults have it. A text that is null or has no words brings no evidence: it takes its path's posterior. Null hosts and paths are groups of
    their own. Labels other than 0 and 1 are left out; repeated ones count once, the higher of two. Without labels of both classes every
    document is accepted, with posterior 1. Other columns are ignored; no rows give no rows.
    """
    return _posteriors(docs, labels, host_col, path_col, train_rows, [])


def _posteriors(docs: DataFrame, labels: DataFrame, host_col: str, path_col: str, train_rows: int, keys: list[str]) -> DataFrame:
    base = docs.select(*keys, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("\0null")).alias("host"), F.coalesce(F.col(path_col).cast("string"), F.lit("\0null")).alias("path"), "text")
    model = train(base, labels, train_rows)
    if model is None:
        one = F.lit(1.0)
        return base.select(*keys, "doc_id", F.lit(None).cast("double").alias("evidence"), one.alias("host_posterior"), one.alias("path_posterior"), one.alias("posterior"), F.lit(True).alias("accepted"))
    scored = stored(mapped(base, lambda b: _evidence(b, model), "".join(f"{k} long, " for k in keys) + "doc_id long, host string, path string, p double"), "quality-evidence")
    paths = stored(scored.where("p is not null").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    within = lambda g: g.withColumn("w", F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    prior = paths.agg(F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.5))).first()[0]
    k_host = within(hosts).agg(_strength(hosts, F.lit(prior))).first()[0]
    hosts = hosts.select("host", ((F.col("s") + k_host * prior) / (F.col("n") + k_host)).alias("host_posterior"))
    k_path = within(paths).join(hosts, "host").agg(_strength(paths, F.col("host_posterior"))).first()[0]
    leaves = paths.join(hosts, "host").select("host", "path", ((F.col("s") + k_path * F.col("host_posterior")) / (F.col("n") + k_path)).alias("path_posterior"))
    # A path without evidence takes its host's posterior, a host without any the prior.
    near = scored.join(leaves, ["host", "path"], "left").join(hosts, "host", "left")
    near = near.withColumn("host_posterior", F.coalesce("host_posterior", F.lit(prior))).withColumn("path_posterior", F.coalesce("path_posterior", "host_posterior"))
    odds = _logit(F.col("p")) + _logit(F.col("path_posterior")) - _logit(F.lit(prior))
    posterior = F.coalesce(1 / (1 + F.exp(-odds)), F.col("path_posterior"))
    return near.select(*keys, "doc_id", F.col("p").alias("evidence"), "host_posterior", "path_posterior", posterior.alias("posterior"), (posterior >= THRESHOLD).alias("accepted"))


def accepted_documents(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns. Each row is judged by itself, also where its id is null or repeated."""
    rows = keyed(docs)
    bad = _posteriors(rows, labels, host_col, path_col, train_rows, [ROW]).where("not accepted").select(ROW)
    return rows.join(bad, ROW, "left_anti").select(*docs.columns)
