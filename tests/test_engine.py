"""Table functions, SQL functions, folds, back-off and joined streams."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import mapping, sequences, sql
from tessella.streaming import streams as S


def test_sql_functions_equal_the_column_functions(spark):
    assert set(sql.register(spark)) >= {"tessella_chunks", "tessella_normalize_answer"}
    rows = [("The  Cat, a dog's \\ \"tail\"!",), ("",), (None,), (" an owl ",)]
    spark.createDataFrame(rows, "text string").createOrReplaceTempView("answers_in")
    got = spark.sql("SELECT text, tessella_normalize_answer(text) AS a, tessella_collapse_whitespace(text) AS b, tessella_word_count(text) AS c FROM answers_in")
    want = got.select("text", T.normalize_answer(F.col("text")).alias("a"), T.collapse_whitespace(F.col("text")).alias("b"), F.size(T.tokens(F.coalesce("text", F.lit("")))).alias("c"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_table_functions(spark):
    sql.register(spark)
    spark.createDataFrame([(1, "a b c d e", "x"), (2, None, "y"), (3, "  ", "z")], "id long, text string, other string").createOrReplaceTempView("chunks_in")
    got = spark.sql("SELECT * FROM tessella_chunks(TABLE(chunks_in), 'text', 3, 2)")
    assert got.columns == ["id", "other", "chunk", "n_words", "chunk_text"]
    assert sorted(map(tuple, got.collect())) == [(1, "x", 0, 3, "a b c"), (1, "x", 1, 3, "c d e")]
    for bad in ("tessella_chunks(TABLE(chunks_in), 'none', 3, 2)", "tessella_chunks(TABLE(chunks_in), 'text', 0, 2)"):
        with pytest.raises(Exception, match="missing|1 or more"):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_a_fold_walks_through_batches_with_one_state(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(None if k % 3 == 0 else k % 3, k, k * k % 10) for k in range(300)]  # a third has no key
        df = spark.createDataFrame(rows, "key long, at long, x long").repartition(3)
        got = sequences.folded(df, ["key"], ["at"], lambda s, r: (s + r["x"], (r["key"], r["at"], s + r["x"])), 0, "key long, at long, total long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    sums, want = {}, []
    for key, at, x in sorted(rows, key=lambda r: r[1]):
        sums[key] = sums.get(key, 0) + x
        want.append((key, at, sums[key]))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_batches_are_halved_after_memory_errors(spark):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        if batch.num_rows > 10:
            raise MemoryError
        return batch

    out, halvings = mapping.map_halving(spark.range(1000).coalesce(1), fn, "id long", rows=64)
    assert sorted(r.id for r in out.collect()) == list(range(1000))
    assert halvings.value == 3  # 64, 32, 16, then 8 for the rest

    def never(batch: pa.RecordBatch) -> pa.RecordBatch:
        raise MemoryError

    with pytest.raises(Exception, match="MemoryError"):
        mapping.map_halving(spark.range(4), never, "id long")[0].collect()


def test_joined_streams_equal_the_batch_join_and_forget(spark, tmp_path):
    """Thirty files in order of time, one a batch: the state holds a bounded part of them."""
    first = dt.datetime(2024, 1, 1)
    rows = [(k, k % 5, first + dt.timedelta(minutes=k), ("click", "buy")[k % 2]) for k in range(1500)]
    schema = "event_id long, user_id long, ts timestamp, kind string"
    for n in range(30):
        spark.createDataFrame(rows[n * 50 : n * 50 + 50], schema).coalesce(1).write.parquet(str(tmp_path / f"events.parquet/part={n:02d}"))
    import os
    import time

    for n in range(30):  # files are taken in order of their times
        for f in (tmp_path / f"events.parquet/part={n:02d}").iterdir():
            os.utime(f, (time.time() - 1000 + n, time.time() - 1000 + n))
    stream = S.replay(spark, str(tmp_path / "events.parquet"), files_a_batch=1)
    side = lambda kind: stream.where(F.col("kind") == kind).select("event_id", "user_id", "ts")
    held = []
    joined = S.interval_join(side("click"), side("buy"), "user_id", "ts", "30 minutes", "10 minutes")
    got = S.drained(joined.select("event_id", "right_event_id"), state_rows=held)
    want = {(a[0], b[0]) for a in rows for b in rows if a[3] == "click" and b[3] == "buy" and a[1] == b[1] and a[2] <= b[2] <= a[2] + dt.timedelta(minutes=30)}
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 1000
    assert len(held) >= 30 and max(held) < 250


def test_model_of_pairs_adds_up_to_one(spark):
    from tessella.operators.language import START, KneserNey, word_pairs

    texts = ["a b a b c", "a b c d", "b c", "", None, "a a a b", "d c b a b", "a b c d e a b c", "e e e e a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pairs = word_pairs(docs, "id", T.tokens(F.col("text")))
    model = KneserNey(pairs)
    p = {(r.before, r.word): r.p for r in model.table.collect()}
    share, spread = {r.before: r.share for r in model.backing.collect()}, {r.word: r.spread for r in model.spread.collect()}
    for before in "abcde":
        assert sum(p.get((before, w), share[before] * spread[w]) for w in spread) == pytest.approx(1)
    other = spark.createDataFrame([(1, "a d"), (2, "e unknown"), (3, "d d")], "id long, text string")
    got = {r.id: r for r in model.scores(word_pairs(other, "id", T.tokens(F.col("text")))).collect()}
    first = p.get((START, "a"))
    import math

    assert got[1].nll == pytest.approx(-math.log(first) - math.log(p.get(("a", "d"), share["a"] * spread["d"])))
    assert got[2].perplexity == math.inf and got[3].n_words == 2


def test_word_pairs_are_counted_where_they_are_read(spark):
    from tessella.operators.language import START, word_pairs

    docs = spark.createDataFrame([(1, "a b a b a"), (2, ""), (3, None), (4, "a"), (5, "b b b")], "id long, text string")
    pairs = word_pairs(docs, "id", T.tokens(F.col("text")))
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, pairs.collect())) == [(1, START, "a", 1), (1, "a", "b", 2), (1, "b", "a", 2), (4, START, "a", 1), (5, START, "b", 1), (5, "b", "b", 2)]


def test_texts_meet_the_model_of_themselves_once(spark, monkeypatch):
    """one join, narrow rows without words, and the scores of the model that is stored with its words."""
    from tessella.operators import language as L

    texts = ["a b a b c", "a b c d", "b c", "", None, "a a a b", "d c b a b", "a b c d e a b c", "e e e e a b", "f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    pairs = L.word_pairs(docs, "id", T.tokens(F.col("text")))
    want = {r.id: r for r in L.KneserNey(pairs).scores(pairs).collect()}
    monkeypatch.setattr(L, "SUM_ROWS", 3)
    kept, stored = [], L.stored
    monkeypatch.setattr(L, "stored", lambda df, name: kept.append(df) or stored(df, name))
    scores = L.own_scores(pairs)
    got = {r.id: r for r in scores.collect()}
    assert got.keys() == want.keys() and len(got) == 8
    for i, r in got.items():
        assert (r.n_words, r.nll, r.perplexity) == (want[i].n_words, pytest.approx(want[i].nll), pytest.approx(want[i].perplexity))
    assert kept and all(kind == "bigint" for df in kept for _, kind in df.dtypes)
    assert scores._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert L.own_scores(pairs.limit(0)).count() == 0
