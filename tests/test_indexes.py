"""Stored indexes against exact searches and definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.stems import measure, stem
from tessella.operators import ann, retrieval, textindex
from tessella.operators.textindex import TextIndex

SCHEMA = "vec_id long, embedding array<float>"


def clustered(spark, n=1500, dim=24):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (20, dim))
    rows = [(i, [float(v) for v in centres[0 if i % 3 == 0 else i % 20] + rng.normal(0, 0.4, dim)]) for i in range(n)]  # one cell holds a third
    return spark.createDataFrame(rows, SCHEMA)


def test_factory_strings():
    assert ann.factory("IVF64,PQ8") == ann.Factory("ivf", cells=64, code_bytes=8)
    assert ann.factory("IVF4096,Flat").code_bytes == 0 and ann.factory("HNSW32,Flat").links == 32 and ann.factory("Flat").kind == "flat"
    for bad in ("IVF0,Flat", "PQ8", "IVF8", "HNSW", ""):
        with pytest.raises(ValueError):
            ann.factory(bad)


@pytest.mark.parametrize("index", ["IVF16,PQ6", "IVF16,Flat", "HNSW12", "Flat"])
@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_recall_of_every_index(spark, index, metric):
    v = clustered(spark)
    q = v.where("vec_id % 20 = 0")
    built = ann.VectorIndex.load(spark, ann.VectorIndex.build(v, index, metric).path)
    true = retrieval.knn(q, v, 10, metric)
    found = built.search(q, 10)
    assert ann.recall(found, true).first()[2] >= 0.9
    scores = {(r.qid, r.pid): r.score for r in true.collect()}
    assert all(abs(scores[r.qid, r.pid] - r.score) < 1e-9 for r in found.collect() if (r.qid, r.pid) in scores)  # scores are those of the vectors
    exact = built.search(q, 10, exact=True)
    assert exact.select("qid", "pid", "rank").exceptAll(true.select("qid", "pid", "rank")).count() == 0
    assert built.vectors().count() == 1500


def test_indexes_of_few_odd_and_no_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 1.0]), (4, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for index in ("IVF8,PQ2", "HNSW4", "IVF8,Flat"):
        hits = ann.VectorIndex.build(df, index).search(df.where("vec_id = 1").limit(1), 5).collect()
        assert [(r.pid, r.rank) for r in sorted(hits, key=lambda r: r.rank)] == [(1, 1), (1, 2), (2, 3)]
        assert ann.VectorIndex.build(df.limit(0), index).search(df, 5).count() == 0


def test_beams_reach_all_of_a_small_graph():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (300, 8))
    place, d = ann.beam_search(x[:20], x, ann.links(x, 8), 300)
    want = ann._distances(x[:20], x).argsort(axis=1, kind="stable")
    assert (np.sort(place, axis=1) == np.arange(300)).all() and (place[:, 0] == want[:, 0]).all()


def test_code_distances_are_those_of_the_decoded_vectors():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (400, 10))
    model = ann.fitted(x, ann.factory("IVF4,PQ3"), "l2", 0.0)
    cell, code = model.placed(x)
    decoded = np.stack([model.codebooks[m][code[:, m]] for m in range(3)], axis=1).reshape(400, -1)[:, :10] + model.centroids[cell]
    for c in range(4):
        rows = np.flatnonzero(cell == c)
        np.testing.assert_allclose(model.by_code(x[:5], c, code[rows]), ((x[:5, None] - decoded[rows]) ** 2).sum(2), atol=1e-9)


# ---------------------------------------------------------------- texts


def test_published_stems():
    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl hopping hop falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit digitizer digit triplicate triplic formative form electrical electr goodness good revival reviv adjustable adjust adoption adopt controll control rate rate cease ceas generalizations gener oscillators oscil".split()
    assert [(w, stem(w)) for w in pairs[::2]] == list(zip(pairs[::2], pairs[1::2]))
    assert [measure(w) for w in "tree by trouble oats trees ivy troubles private oaten".split()] == [0, 0, 1, 1, 1, 1, 2, 2, 2]
    assert stem("") == "" and stem("naïves") == "naïves" and stem("x7s") == "x7s"


def scored(docs, queries, k, k1=0.82, b=0.68, stemmed=False):
    words = {i: textindex.analyzed(t, stemmed) for i, t in docs}
    average = sum(map(len, words.values())) / len(words)
    out = []
    for qid, text in queries:
        hits = []
        for i, ws in words.items():
            s = 0.0
            for t in set(textindex.analyzed(text, stemmed)):
                df = sum(t in w for w in words.values())
                tf = ws.count(t)
                s += np.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ws) / average)) if tf else 0
            if s:
                hits.append((-round(s, 6), i))
        out += [(qid, i, r + 1) for r, (s, i) in enumerate(sorted(hits)[:k])]
    return sorted(out)


@pytest.mark.parametrize("stemmed", [False, True])
def test_text_index_equals_a_full_scan(spark, monkeypatch, stemmed):
    monkeypatch.setattr(textindex, "SEGMENT", 40)
    monkeypatch.setattr(textindex, "BLOCK", 4)
    rng = np.random.default_rng(6)
    vocabulary = [f"{s}{e}" for s in ("walk", "jump", "relat", "hop", "common") for e in ("s", "ed", "ing", "")]
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=np.arange(1, 21) / 210))
    docs = [(i, text(int(rng.integers(0, 40)))) for i in range(150)] + [(200, "The Rare-word, jumps"), (201, "")]
    queries = [(1, "jumping walks"), (2, "rare word common"), (3, "nothing"), (4, ""), (5, " ".join(vocabulary)), (6, "common commons")]
    df = spark.createDataFrame([*docs, (None, "jump"), (300, None)], "doc_id long, text string")
    index = TextIndex.build(df, stemmed=stemmed)
    asked = spark.createDataFrame(queries, "item_id long, text string")
    got = sorted((r.qid, r.pid, r["rank"]) for r in TextIndex(spark, index.path).search(asked, 5).collect())
    assert got == scored(docs, queries, 5, stemmed=stemmed)
    counts = index.search(asked, 5, counts=True).agg(F.sum("pid"), F.sum("score")).first()
    assert counts[0] > 0
    assert TextIndex.build(df.limit(0)).search(asked, 5).count() == 0


def test_blocks_that_cannot_matter_are_skipped():
    """A rare heavy word decides; most blocks of a common word hold none of its documents."""
    rare = (np.arange(5), np.full(5, 2.0), 2.0)
    common = [(np.arange(a, a + 128), np.full(128, 1.0), 1.0) for a in range(0, 128 * 50, 128)]
    found, score, read, skipped = textindex.best_of_segment([(0.1, common), (9.0, [rare])], 128 * 50, 5)
    assert found.tolist() == [0, 1, 2, 3, 4] and np.allclose(score, 18.1) and (read, skipped) == (2, 49)


def test_graph_is_measured_by_vectors_that_are_not_in_it():
    x = np.random.default_rng(5).normal(size=(3200, 48))
    model = ann.fitted(x[:3000], ann.factory("HNSW16,Flat"), "l2", 0.0)
    shard, asked = x[:3000], x[3000:]
    true = ann._least(ann._distances(asked, shard), 10)
    found = ann.beam_search(asked, shard, ann.links(shard, 16), model.reach)[0][:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(true.tolist(), found.tolist())]) >= 9


def test_vectors_are_coded_in_bounded_steps():
    import pyarrow as pa

    x = np.random.default_rng(4).normal(size=(2500, 8))
    model = ann.fitted(x, ann.factory("IVF4,PQ2"), "l2", 0.0)
    batch = pa.record_batch([pa.array(np.arange(2500)), pa.array(list(x))], ["pid", "v"])
    steps = list(ann._encode(iter([batch]), model))
    assert max(s.num_rows for s in steps) <= 1024
    cell, code = model.placed(x)
    assert [c for s in steps for c in s.column("cell").to_pylist()] == cell.tolist()
    assert [c for s in steps for c in s.column("code").to_pylist()] == [c.tobytes() for c in code]
