import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import parity_join
from tessella.llm.exact_dedup import exact_dedup, kept_documents
from tessella.llm.parity_join import components, keep_one, ngram_jaccard_join
from tessella.llm.substring_dedup import substring_dedup

from . import brute

SCHEMA = "doc_id long, text string"


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def corpus(seed=3):
    """Exact, upper-case and near copies, shared passages, repeats inside a text, odd and empty texts."""
    rng, rows = random.Random(seed), []
    passage = " ".join(words(rng, 60))
    base = words(rng, 120)
    rows += [(k, " ".join(words(rng, rng.randrange(1, 90)))) for k in range(40)]
    rows += [(40 + k, " ".join(words(rng, 20)) + " " + passage + "\t" + " ".join(words(rng, 15))) for k in range(10)]
    for k in range(30):
        copy = list(base)
        for _ in range(k // 3):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((50 + k, " ".join(copy)))
    rows += [(80, " ".join(base).upper()), (81, passage + " " + passage), (82, None), (83, ""), (84, " \n\t "), (85, "one two"), (86, "ONE  two"), (87, "a"), (88, "naïve café " * 30), (89, " ".join(words(rng, 20_000)))]
    rows += [(90 + k, " ".join(base[k:])) for k in range(12)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def table(spark, rows, **extra):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name, value in extra.items():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(value))
    return df


def test_substring_dedup_equals_brute_force(spark, rows):
    got = sorted(map(tuple, substring_dedup(table(spark, rows, n_words=1, part="x", blob="y")).collect()))
    assert got == sorted(brute.substring_dedup(rows))


def test_substring_dedup_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, substring_dedup(docs).collect())) == sorted(brute.substring_dedup(rows))


def test_substring_dedup_odd_rows(spark):
    assert substring_dedup(table(spark, [])).count() == 0
    text = " ".join(f"w{k}" for k in range(25))
    out = {r.doc_id: r for r in substring_dedup(table(spark, [(None, text), (5, text), (5, text), (7, text + " tail")])).collect()}
    assert out[None].n_removed == 0 and out[5].n_removed == 25
    assert out[7].kept_text == "tail"
    again = substring_dedup(table(spark, [(5, text), (5, text)])).collect()
    assert sorted(r.n_removed for r in again) == [0, 25]


def test_substring_dedup_tells_rows_apart_that_share_an_id_or_have_none(spark, tmp_path):
    """A row loses only words of its own windows, whatever other rows have its id."""
    a, b = [f"a{k}" for k in range(50)], [f"b{k}" for k in range(60)]
    texts = [" ".join(a + a[:20]), " ".join(b), " ".join(b[10:40]), None, "", " ".join(a)]
    rows = [(i, t) for i in (7, None, 3) for t in texts]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "rows"))  # places in a file, in this order
    got = sorted(map(tuple, substring_dedup(spark.read.parquet(str(tmp_path / "rows"))).collect()), key=repr)
    assert got == sorted(brute.substring_dedup(rows), key=repr)
    only = sorted(map(tuple, substring_dedup(spark.createDataFrame([(7, texts[0]), (7, texts[1])], SCHEMA)).collect()))
    assert sorted(r[2] for r in only) == [0, 20]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), max_size=6))
def test_substring_dedup_small_alphabets(spark, texts):
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = sorted(map(tuple, substring_dedup(spark.createDataFrame(rows, SCHEMA), size=4).collect()))
    assert got == sorted(brute.substring_dedup(rows, 4))


def test_exact_dedup_equals_brute_force(spark, rows):
    got = {r[0]: tuple(r)[1:] for r in exact_dedup(table(spark, rows, keep_id=1, _bytes=2, _full="z"), digest=True).collect()}
    assert got == brute.exact_groups(rows)


def test_exact_dedup_odd_rows(spark):
    assert exact_dedup(table(spark, [])).count() == 0
    out = sorted(map(tuple, exact_dedup(table(spark, [(1, "A"), (1, "A"), (2, "a"), (None, "a"), (None, "é"), (3, "É")])).collect()), key=str)
    assert (1, 2, 4, False) in out and (2, 2, 4, True) in out and (None, 2, 4, False) in out
    assert (None, None, 1, True) in out and (3, 3, 1, True) in out  # only A-Z is folded
    assert kept_documents(table(spark, [(1, "A"), (2, "a"), (None, "q")])).count() == 2


def test_ngram_jaccard_join_equals_brute_force(spark, rows):
    got = {r[0]: tuple(r)[1:] for r in ngram_jaccard_join(table(spark, rows, n=1, label=2, rep=3, component=4)).collect()}
    assert got == brute.near_groups(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_jaccard_join_short_sets(spark, seed):
    """Sets of a few shingles, where parts stay empty and single links hold a group together."""
    rng, rows = random.Random(seed), []
    for g in range(60):
        base = [f"g{g}_{k}" for k in range(rng.randrange(5, 40))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.choice([0, -1])] = f"y{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy + [f"z{k}" for k in range(rng.randrange(3))])))
    got = {r[0]: tuple(r)[1:] for r in ngram_jaccard_join(table(spark, rows)).collect()}
    assert got == brute.near_groups(rows)


def test_ngram_jaccard_join_odd_rows(spark):
    assert ngram_jaccard_join(table(spark, [])).count() == 0
    out = sorted(map(tuple, ngram_jaccard_join(table(spark, [(4, "a b c d e f"), (4, "a b c d e f"), (9, "A b c d e f"), (None, "a b c d e f"), (2, None), (3, " ")])).collect()), key=str)
    assert out == [(2, 0, 2), (3, 0, 3), (4, 2, 4), (4, 2, 4), (9, 2, 4), (None, 2, None)]
    assert sorted(r.doc_id for r in keep_one(table(spark, [(4, "a b c d e f"), (9, "A b c d e f"), (2, None)])).collect()) == [2, 4]


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 130), (130, 101)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 130: 100, 101: 100}


def test_a_round_of_components_plans_each_join_once(spark, monkeypatch):
    """Joins that are planned again for every use of a step are broadcasts, and so driver's memory."""
    planned, kept = [], parity_join.stored

    def counting(df, name):
        planned.append(df._jdf.queryExecution().analyzed().toString().count("Join "))
        return kept(df, name)

    monkeypatch.setattr(parity_join, "stored", counting)
    assert components(spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long")).count() == 5
    assert max(planned) <= 3  # 14 where a round is one plan


def near(seed, changed, n=60):
    base = [f"s{seed}_{k}" for k in range(n)]
    base[-1] = changed
    return " ".join(base)


def test_rows_that_repeat_an_id_link_each_by_its_own_text(spark):
    rows = [(1, near(1, "a")), (1, near(2, "a")), (2, near(1, "b")), (3, near(2, "b")), (5, near(3, "a")), (5, near(4, "a")), (4, near(3, "b")), (6, near(4, "b")), (None, near(1, "c")), (None, near(1, "a"))]
    out = sorted(((r.doc_id, r.component_id) for r in ngram_jaccard_join(table(spark, rows)).collect()), key=str)
    assert out == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (5, 4), (5, 5), (4, 4), (6, 5), (None, None), (None, None)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in keep_one(table(spark, rows, gid=1, head=2)).collect()), key=str)
    assert kept == sorted([rows[k] for k in (0, 1, 5, 6, 8, 9)], key=str)
    twice = keep_one(table(spark, [(1, near(1, "a"))] * 3 + [(9, near(1, "b"))])).collect()
    assert [r.doc_id for r in twice] == [1]


def test_linked_pairs_lose_no_link(spark, rows):
    from tessella.llm.parity_join import linked_pairs

    pairs, members = linked_pairs(table(spark, rows))
    sets = {i: brute.shingles(t) for i, t in rows}
    expected = {}
    for a in set(sets.values()):
        for b in set(sets.values()):
            if a != b and a and b and 100 * len(a & b) >= 80 * len(a | b):
                expected.setdefault(a, set()).add(b)
    member = {r.doc_id: r for r in members.collect()}
    assert {i: r.n_links for i, r in member.items()} == {i: len(expected.get(s, ())) for i, s in sets.items()}
    one = {}
    for i, r in member.items():
        assert (r.class_id is None) == (not sets[i])
        assert one.setdefault(r.class_id, sets[i]) == sets[i]
    found = pairs.collect()
    assert len(found) == sum(map(len, expected.values())) // 2 > 100
    for r in found:
        a, b = one[r.class_a], one[r.class_b]
        assert b in expected[a] and (r.shared, r.united) == (len(a & b), len(a | b))


def test_keys_of_short_texts_have_content():
    """Unrelated texts of 8, 12 and 30 words meet nowhere, however many there are."""
    import numpy as np
    import pyarrow as pa

    from tessella.llm.parity_join import Sets, _parts

    rng = np.random.default_rng(0)
    for n in (8, 12, 30):
        sets = Sets(pa.array([" ".join(map(str, r)) for r in rng.integers(0, 10**9, (20_000, n)).tolist()]))
        keys, _ = _parts(sets, np.arange(20_000))
        assert np.unique(keys, return_counts=True)[1].max() <= 2


def test_hot_keys_are_joined_like_others(spark):
    from tessella.llm._common import join_about

    keys = [k % 3 if k % 2 else 0 for k in range(20_000)] + list(range(100, 5000))
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    about = rows.where("k <> 700").groupBy("k").count().withColumn("name", F.concat(F.lit("n"), "k"))
    out = {r.i: (r.k, r.name) for r in join_about(rows, about, ["k"], "count", len(keys)).collect()}
    assert out == {i: (k, None if k == 700 else f"n{k}") for i, k in enumerate(keys)}


def test_kept_documents_judge_each_row(spark):
    rows = [(7, "a"), (7, "b"), (9, "B"), (None, "c"), (None, "a"), (3, "d"), (3, "d")]
    assert sorted(((r.doc_id, r.text) for r in kept_documents(table(spark, rows)).collect()), key=str) == sorted([(7, "a"), (9, "B"), (None, "c"), (3, "d"), (3, "d")], key=str)
