import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import toxicity as tox
from tessella.llm import vector_codes as codes
from tessella.llm import whitening
from tessella.llm._vectors import floors

EMBEDDINGS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def vector(rng, dim=32):
    return [float(np.float32(v)) for v in rng.normal(0, 1, dim)]


def odd_rows(dim=32):
    rng = np.random.default_rng(3)
    rows = [(i, vector(rng, dim), None if i % 7 == 0 else i % 3) for i in range(90)]
    rows += [(1, rows[1][1], 1), (1, rows[1][1], 1), (None, vector(rng, dim), 5), (200, rows[5][1], None)]  # repeated rows, null ids, ties
    return rows + [(300, None, 1), (301, [None] + [0.0] * (dim - 1), 1), (302, [NAN] + [0.0] * (dim - 1), 1), (-5, [-INF] + [0.0] * (dim - 1), 1)]


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[[int(np.floor(256 * v)) for v in r[1]][p * len(r[1]) // parts : (p + 1) * len(r[1]) // parts] for p in range(parts)] for r in kept]
    book = [[x[e][p] for e in range(min(entries, len(kept)))] for p in range(parts)]

    def assign():
        out = []
        for v in x:
            found = [min((sum((a - b) ** 2 for a, b in zip(v[p], entry)), e) for e, entry in enumerate(book[p])) for p in range(parts)]
            out.append(([e for _, e in found], sum(d for d, _ in found)))
        return out

    for _ in range(rounds):
        now = assign()
        for p in range(parts):
            for e in range(len(book[p])):
                mine = [x[i][p] for i, (c, _) in enumerate(now) if c[p] == e]
                if mine:
                    book[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    now = assign()
    total = {}
    for r, (_, d) in zip(kept, now):
        total[r[2]] = total.get(r[2], 0) + d
    text = ",".join(str(v) for p in book for e in p for v in e)
    import hashlib

    return [(r[0], "".join(f"{e:02x}" for e in c), d, total[r[2]], hashlib.sha256(text.encode()).hexdigest()) for r, (c, d) in zip(kept, now)]


@pytest.mark.parametrize("count", [98, 40])
def test_codes_equal_brute_force_on_odd_rows(spark, monkeypatch, count):
    rows = odd_rows()[-count:]
    df = spark.createDataFrame(rows, EMBEDDINGS).withColumn("code", F.lit(1)).withColumn("v", F.lit(2)).withColumn("n", F.lit(3))
    want = sorted(brute_codes(rows), key=repr)
    assert sorted(map(tuple, codes.vector_codes(df).collect()), key=repr) == want
    monkeypatch.setattr(codes, "BLOCK", 7)
    monkeypatch.setattr(codes, "STEP", 3)
    assert sorted(map(tuple, codes.vector_codes(df.repartition(3)).collect()), key=repr) == want


def test_codes_equal_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = codes.vector_codes(spark.read.parquet(f"{sf}/embeddings.parquet"))
    want = c.sql(codes.oracle())
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_codes_of_no_rows_and_of_what_cannot_be_coded(spark):
    none = spark.createDataFrame([], EMBEDDINGS)
    assert codes.vector_codes(none).collect() == [] and codes.vector_codes(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    for rows in ([(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)], [(1, [1.0] * 17, 1)], [(1, [1e30] * 16, 1)]):
        with pytest.raises(Exception, match="components|equal parts|above"):
            codes.vector_codes(spark.createDataFrame(rows, EMBEDDINGS)).collect()


def test_sums_merge_along_the_tree_whatever_the_blocks():
    rng = np.random.default_rng(5)
    x, book = rng.integers(-300, 300, (32, 50)), rng.integers(-300, 300, (16, 8, 2))
    block = lambda a, b: (b - a, x[:, a:b].astype("<i4").tobytes())
    whole = codes._gather(None, block(0, 50), book)
    cut = codes._merge(codes._merge(None, codes._gather(codes._gather(None, block(0, 9), book), block(9, 10), book)), codes._gather(None, block(10, 50), book))
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all() and whole[1].sum() == 16 * 50


def reference_whitening(x):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ v[:, ::-1], e[::-1]


def test_whitening_equals_the_eigenvectors_of_the_covariance(spark, monkeypatch):
    rows = odd_rows()
    df = spark.createDataFrame(rows, EMBEDDINGS).withColumn("x", F.lit(1)).withColumn("component", F.lit(2))
    monkeypatch.setattr(whitening, "STEP", 11)
    kept = [r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])]
    x = floors(np.array([r[1] for r in kept]), 64, 1 << 40) + 1_000_000
    n, deviation, projected, e = reference_whitening(x)
    got = whitening.whiten(df.repartition(5)).collect()
    assert len(got) == 16 * len(kept) and {r.n for r in got} == {n} and n < len(kept)
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation.tolist())
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for k in range(16):
        mine = np.sort([r.whitened for r in got if r.component == k + 1])
        its = projected[:, k] / np.sqrt(e[k])
        assert min(np.abs(mine - np.sort(its)).max(), np.abs(mine - np.sort(-its)).max()) < 1e-8
        assert {r.explained for r in got if r.component == k + 1}.pop() == pytest.approx(e[k] / e.sum(), rel=1e-9)


def test_whitening_of_few_and_no_vectors(spark):
    none = spark.createDataFrame([], EMBEDDINGS)
    assert whitening.whiten(none).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], EMBEDDINGS)
    assert whitening.whiten(same).collect() == []  # no component has any variance
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0], 1) for k in range(5)], EMBEDDINGS)
    got = whitening.whiten(line).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1) and got[0].identity_error < 1e-9
    with pytest.raises(Exception, match="components|lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0], 1), (2, [1.0, 2.0], 1)], EMBEDDINGS)).collect()
    with pytest.raises(Exception, match="above"):
        whitening.whiten(spark.createDataFrame([(1, [1e30], 1)], EMBEDDINGS)).collect()


def test_merged_states_lose_nothing():
    rng = np.random.default_rng(9)
    x = rng.integers(-50, 50, (60, 6)) + 1_000_000
    whole = whitening.decomposed(x)
    state = whitening.decomposed(x[:1])
    for a, b in ((1, 3), (3, 30), (30, 60)):  # fewer rows than dimensions, and more
        state = whitening.merged(state, whitening.decomposed(x[a:b]))
    assert state[0] == 60 and (state[1] == whole[1]).all()
    np.testing.assert_allclose((state[2][:, None] * state[3]).T @ (state[2][:, None] * state[3]), (x - x.mean(0)).T @ (x - x.mean(0)), rtol=1e-9, atol=1e-7)


# ---------------------------------------------------------------- toxicity


def toy(n=900, seed=1):
    """Texts of invented words; a third holds one of five words that mark them, or an inflected stem."""
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.integers(300)}" for _ in range(int(rng.integers(3, 60)))]
        bad = bool(rng.random() < 0.3)
        if bad:
            words[int(rng.integers(len(words)))] = f"bad{rng.integers(5)}" if rng.random() < 0.5 else f"grumpf{chr(97 + int(rng.integers(26)))}{chr(97 + int(rng.integers(26)))}"
        docs.append((i, " ".join(words), ("en", "de", None)[i % 3], f"s{i % 4}"))
        labels.append((i, int(bad)))
    return docs, labels


DOCS, LABELS = "doc_id long, text string, lang string, source string", "doc_id long, toxic int"


@pytest.fixture(scope="module")
def toy_scores(spark):
    docs, labels = toy()
    odd = [(None, None, "en", None), (5000, "", None, None), (5001, None, None, None), (5002, "GRUMPFQQ x", "en", "s"), (5002, "bad1 " + "w1 " * 20_000, "en", "s"), (5003, "w1 " * 30_000 + "bad1", None, None), (5004, "w1 " * 9, "xx", None)]
    marks = [*labels, (5000, None), (None, 1), (7, 1 - labels[7][1]), (8, 5), (9999, 1)]
    d = spark.createDataFrame(docs + odd, DOCS).withColumn("score", F.lit(1.0)).withColumn("key", F.lit(1)).withColumn("toxic", F.lit(1))
    return docs, labels, odd, tox.toxicity(d, spark.createDataFrame(marks, LABELS)).collect()


def test_toxicity_finds_held_out_texts(toy_scores):
    docs, labels, odd, got = toy_scores
    assert len(got) == len(docs) + len(odd)
    truth = dict(labels)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in out) > 0.9 * len(out) > 100
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.flagged == (r.score >= r.lang_threshold) for r in got)
    assert all(r.lang_threshold == 0.5 for r in got if r.lang in (None, "xx"))


def test_toxicity_of_odd_texts(toy_scores):
    got = toy_scores[3]
    none = {r.score for r in got if r.doc_id in (None, 5000, 5001)}
    assert len(none) == 1 and none.pop() < 0.5
    assert all(r.predicted for r in got if r.doc_id in (5002, 5003)) and not any(r.predicted for r in got if r.doc_id == 5004)


def test_scores_hang_on_the_text_alone(spark, toy_scores):
    docs, labels, _, before = toy_scores
    other = [(i, t, "fr", "z") for i, t, _, _ in docs]
    changed = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels if i not in (7,)] + [(7, 0), (7, 1), (9999, 1)]
    after = {r.doc_id: r.score for r in tox.toxicity(spark.createDataFrame(other, DOCS).repartition(3), spark.createDataFrame(changed, LABELS)).collect()}
    assert all(abs(r.score - after[r.doc_id]) < 1e-6 for r in before if r.doc_id in after)


def test_toxicity_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame(toy(20)[0], DOCS)
    for marks, score in (([], 0.0), ([(2, 1), (3, 1)], 1.0), ([(2, 0)], 0.0)):
        got = tox.toxicity(docs, spark.createDataFrame(marks, LABELS)).collect()
        assert len(got) == 20 and {r.score for r in got} == {score}
    assert tox.toxicity(docs.limit(0), spark.createDataFrame(toy(20)[1], LABELS)).collect() == []


def test_pooling_equals_its_definition(monkeypatch):
    docs, labels = toy(60)
    monkeypatch.setattr(tox, "LEAST_TEXTS", 2)
    texts = [t for _, t, _, _ in docs] + ["", None, "w1 w2"]
    bags = tox.bags(pa.array(texts))
    net = tox.trained(bags, np.array([y for _, y in labels] + [0, 0, 0]), epochs=1)
    vectors = net.embeddings[net.rows(bags.table)].sum(axis=1)
    want = np.zeros((len(texts), len(tox.WIDTHS) * tox.FILTERS))
    for i in range(len(texts)):
        x = np.concatenate([vectors[bags.places[bags.bound[i] : bags.bound[i + 1]]], np.zeros((tox.PAD, tox.DIM))])
        for w, f in enumerate(net.filters):
            for k in range(tox.FILTERS):
                at = [sum(float(x[p + j] @ f[j][:, k]) for j in range(len(f))) for p in range(len(x) - tox.PAD)]
                want[i, w * tox.FILTERS + k] = max([a + net.bias[w * tox.FILTERS + k] for a in at] + [0])
    for run in (1, 5, 1 << 12):
        monkeypatch.setattr(tox, "RUN", run)
        np.testing.assert_allclose(net.pooled(bags), want, atol=1e-4)


def test_best_threshold_is_the_middle_of_the_gap():
    z, y = np.array([3.0, 2.0, -1.0, -2.0]), np.array([1, 1, 0, 0])
    assert tox.best_threshold(z, y, np.ones(4)) == 0.5
    assert tox.best_threshold(np.array([1.0, 1.0, 0.0]), np.array([1, 0, 0]), np.ones(3)) == 0.5  # equal values stay on one side


def test_every_labelled_text_is_learned_from(spark, monkeypatch):
    """What F9 found: no bound on the rows or bytes of the labelled texts, and several parts are one network."""
    docs, labels = toy(700, seed=4)
    docs.append((700, "rareword " + "w1 " * 700_000, "en", "s"))  # more than a twentieth of the former 32 MB
    docs += [(701 + i, "rareword w2", "en", "s") for i in range(60)]
    labels += [(i, 0) for i in range(700, 761)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")  # several tasks
    held, tasks, sizes = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(761)], [], []

    def network_of(parts):
        tasks.append(parts.rdd.getNumPartitions())
        sizes.append(sorted(r.n for r in parts.where("copy = 0").selectExpr("length(text) as n").collect()))
        return before(parts)

    before = tox.network_of
    monkeypatch.setattr(tox, "network_of", network_of)
    d, marks = spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)
    apart = spark.createDataFrame([(i,) for i in range(761)], "doc_id long").where(F.pmod(F.xxhash64("doc_id", F.lit(tox.SEED)), F.lit(tox.CALIBRATION)) == 0)
    apart = {r.doc_id for r in apart.collect()}
    model, again = tox.train(d, marks), tox.train(d.repartition(2), marks)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    trains = [i for i in range(761) if not held[i] and i not in apart]
    assert sizes == 2 * [sorted(len(docs[i][1]) for i in trains)] and tasks[0] > 1
    z = model.scores(pa.array([t for _, t, _, _ in docs[:700]]))
    right = [(s >= 0.5) == y for s, (_, y), h in zip(z, labels, held) if h]
    assert sum(right) > 0.9 * len(right) > 90
    assert np.abs(again.scores(pa.array(["w1 bad1", "w2 w3"])) - model.scores(pa.array(["w1 bad1", "w2 w3"]))).max() < 1e-6


def test_buckets_are_counted_over_all_texts(spark):
    texts = [f"w{k % 7} x{k % 3}" for k in range(90)]
    y = np.array([k % 2 for k in range(90)])
    rows = spark.createDataFrame([(int(y[k]), t) for k, t in enumerate(texts)], "toxic int, text string").repartition(4)
    got = rows.mapInArrow(tox._counts, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b")).collect()
    want = tox.counted(tox.bags(pa.array(texts)), y)
    assert {r.bucket: (r.a, r.b) for r in got} == {int(k): tuple(want[:, k].tolist()) for k in np.flatnonzero(want.any(axis=0))}
    assert want[:, tox.BUCKETS].tolist() == [45, 45]
