import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tessella.llm import mixing, queries
from tessella.llm.quality import quality_posteriors

from . import brute

TABLES = "documents benchmark labels pages conversations embeddings".split()


def test_stages_against_brute_force(spark, sf):
    """Every stage on all that its predecessor kept."""
    docs = queries.table(spark, sf, "documents")
    columns = docs.columns
    names = [n for n, _ in P.STAGES]
    assert len(names) == 5
    stage = dict(P.STAGES)

    def step(name, docs):
        return spark.createDataFrame(stage[name](spark, docs, sf).collect(), docs.schema)

    rejected = {r.doc_id for r in quality_posteriors(docs, queries.table(spark, sf, "labels")).where("not accepted").collect()}
    good = step(names[0], docs)
    assert good.columns == columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in docs.collect()} - rejected and rejected

    near = step(names[1], good)
    groups = brute.near_groups([(r.doc_id, r.text) for r in good.collect()])
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, c in groups.values()})

    clean = step(names[2], near)
    hits = brute.contaminated([(r.doc_id, r.text) for r in near.collect()], [(r.item_id, r.text) for r in queries.table(spark, sf, "benchmark").collect()])
    assert {r.doc_id for r in clean.collect()} == {i for i, v in hits.items() if not v[4]}

    mixed = step(names[3], clean)
    db = duckdb.connect()
    db.register("documents", clean.toPandas())
    wanted = {r[0]: r[1:] for r in db.sql(f"SELECT doc_id, epochs, take_tokens, n_tokens FROM ({mixing.oracle()})").fetchall()}
    texts = {r.doc_id: r.text for r in clean.collect()}
    expected = []
    for i, (epochs, take, n) in wanted.items():
        expected += [(i, texts[i])] * epochs
        if take > epochs * n:
            expected.append((i, " ".join(brute.SPACED.findall(texts[i])[: take - epochs * n])))
    assert mixed.columns == columns
    assert sorted((r.doc_id, r.text) for r in mixed.collect()) == sorted(expected)
    assert all(r.n_chars == len(r.text) for r in mixed.collect())

    tokens = stage[names[4]](spark, mixed, sf).collect()
    assert len(tokens) == len(expected)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    crc = sorted((i, zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, t in expected)
    assert sorted((r.doc_id, r.ids_crc32) for r in tokens) == crc
    at = 0
    for r in sorted(tokens, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_run_returns_the_last_stage(spark, sf):
    out = P.run(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = queries.QUERIES[name](spark, d)
    want = db.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [list(want.columns).index(c) for c in columns]
    key = lambda rows: sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows)
    text = lambda rows: sorted(map(str, key(rows))) if any(None in r for r in rows) else key(rows)
    a, b = got.select(*[F.col(f"`{c}`") for c in columns]).collect(), [tuple(r[k] for k in order) for r in want.fetchall()]
    assert sorted(map(str, (tuple(r) for r in a))) == sorted(map(str, b)) or text([tuple(r) for r in a]) == text(b)
