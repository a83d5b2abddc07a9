"""Hand-computed cases of the operators."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import amounts as A
from tessella.functions import english as N
from tessella.functions import procedural as P
from tessella.operators import evaluate as E
from tessella.operators import order as O
from tessella.operators import retrieval as R
from tessella.operators import sequences as S
from tessella.streaming import streams as L


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_shards(spark):
    ids = spark.range(10).withColumnRenamed("id", "r")
    sizes = lambda c: [r["count"] for r in ids.groupBy(c.alias("s")).count().orderBy("s").collect()]
    assert sizes(O.shard_rest_to_last(F.col("r"), 10, 4)) == [2, 2, 2, 4]
    assert sizes(O.shard_balanced(F.col("r"), 10, 4)) == [3, 3, 2, 2]
    assert sizes(O.round_robin(F.col("r"), 2, 3)) == [4, 4, 2]


def test_row_numbers_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(3.0, "b"), (1.0, "a"), (None, "z"), (3.0, "a"), (2.0, "q")], "k double, t string").repartition(3)
    got = {(r.k, r.t): r.row_id for r in O.with_row_number(df, "k", "t", parts=3).collect()}
    assert got == {(None, "z"): 0, (1.0, "a"): 1, (2.0, "q"): 2, (3.0, "a"): 3, (3.0, "b"): 4}


def test_hash_split_is_stable(spark):
    df = spark.range(5000)
    n = df.where(O.hash_split(F.col("id")) == "test").count()
    assert 850 < n < 1150 and n == df.repartition(7).where(O.hash_split(F.col("id")) == "test").count()


def test_phrases_are_mined_from_all_documents(spark, tmp_path):
    from collections import Counter

    from tessella.plans.catalog import QUERIES

    texts = ["a b c d e f g h", "a  b\n c", "b c", "x", "", None, "a b c d e f g h", "b c " * 40]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = [(t or "").split() for t in texts]
    want = Counter((" ".join(w[i : i + n]), n) for w in words for n in range(2, 8) for i in range(len(w) - n + 1))
    assert {(r.ngram, r.n): r.cnt for r in QUERIES["corpus_ngram_counts"](spark, str(tmp_path)).collect()} == want
    top = sorted(((g, n, c) for (g, n), c in want.items()), key=lambda x: (-x[2], x[1], x[0]))[:200]
    assert [(r.ngram, r.n, r.cnt) for r in QUERIES["corpus_top_vocab"](spark, str(tmp_path)).collect()] == top


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_knn_and_ties(spark):
    v = vectors(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)])
    got = [(r.pid, r["rank"]) for r in R.knn(v.where("vec_id = 1"), v, 5).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3)]
    assert [r.score for r in R.knn(v.where("vec_id = 1"), v, 1, "l2").collect()] == [0.0]
    assert R.knn(v.limit(0), v, 3).count() == 0 and R.knn(v, v.limit(0), 3).count() == 0


def test_knn_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)
    v = vectors(spark, [(k, [float(k), 1.0]) for k in range(7)])
    assert R.knn(v, v, 2).count() == 14


def test_merge_top(spark):
    hits = spark.createDataFrame([(0, 0, 3.0), (0, 1, 1.0), (0, 2, 2.0)], "qid long, pid long, score double")
    assert [r.pid for r in R.merge_top(hits, 2).orderBy("rank").collect()] == [0, 2]


def test_attach_and_gather(spark):
    q = spark.createDataFrame([(1,), (2,)], "qid long")
    hits = spark.createDataFrame([(1, 9, 2), (1, 8, 1)], "qid long, pid long, rank int")
    lists = R.attach_neighbors(q, hits)
    assert {r.qid: r.neighbors for r in lists.collect()} == {1: [8, 9], 2: []}
    texts = spark.createDataFrame([(8, "x")], "id long, text string")
    assert {r.qid: r.t for r in R.gather(lists, texts, "qid", "neighbors", "id", "text", "t").collect()} == {1: ["x"], 2: []}
    assert value(spark, R.pad_missing(F.array(F.lit(5).cast("long"), F.lit(-1).cast("long")), 3)) == [5, -1, -1]


def test_bm25_prefers_rare_words(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the dog"), (3, "the the the"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(7, "The CAT")], "item_id long, text string")
    assert R.bm25(q, docs, 1).first().pid == 1


def test_best_threshold(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.1, True, False), ("b", 0.0, 0.9, False, False)], "k string, s double, na double, h boolean, e boolean")
    r = E.best_threshold(rows, "k", "s", "na", "h", "e").first()
    assert (r.best, r.threshold, r.has_answer_mean) == (100.0, 0.1, 1.0)


def test_metrics_on_empty_input(spark):
    df = spark.createDataFrame([], "prediction string, gold string")
    r = E.mean_scores(df).first()
    assert r.n == 0 and r.f1 is None


def test_task_dispatch(spark):
    rows = spark.createDataFrame([(1, 1), (0, 1), (1, 1), (0, 0)], "prediction int, label int")
    assert E.task_metrics("sst-2", rows).first().acc == 0.75
    assert E.task_metrics("mrpc", rows).first().f1 == 0.8
    with pytest.raises(KeyError):
        E.task_metrics("nothing", rows)


def test_word_error_rate(spark):
    assert value(spark, E.word_error_rate(F.lit("a b c d"), F.lit("a x c"))) == 0.5


def test_clock_and_objective(spark):
    assert value(spark, E.clock_seconds(F.lit("1:02:03"))) == 3723.0 and value(spark, E.clock_seconds(F.lit("5"))) == 5.0
    m = F.create_map(F.lit("eval_loss"), F.lit(2.0), F.lit("epoch"), F.lit(1.0))
    assert value(spark, E.objective(m)) == 2.0


def test_blocks_and_strides(spark):
    a = F.sequence(F.lit(0), F.lit(6))
    assert value(spark, S.fixed_blocks(a, 3)) == [[0, 1, 2], [3, 4, 5]]
    assert [r.start for r in value(spark, S.strided_chunks(a, 4, 2))] == [0, 2, 4]
    assert [tuple(r) for r in value(spark, S.scoring_windows(F.lit(7), 4, 2))] == [(0, 4, 4), (2, 6, 2), (4, 7, 1)]
    assert value(spark, S.fixed_blocks(F.array().cast("array<int>"), 3)) == []


def test_byte_chunks(spark):
    got = [tuple(r) for r in value(spark, S.byte_chunks(F.encode(F.lit("0123456789"), "UTF-8"), 6, 1, 1))]
    assert got == [(0, 6, 0, 1), (4, 6, 1, 1), (8, 2, 1, 0)]
    out, _, _ = L.chunk_stream(b"", b"0123456789", 6, 1, 1, False, True)
    assert [(len(c), a, b) for c, a, b in out] == [(6, 0, 1), (6, 1, 1), (2, 1, 0)]


def test_span_candidates(spark):
    s, e = F.array(F.lit(0.1), F.lit(0.9)), F.array(F.lit(0.2), F.lit(0.8))
    assert [(x.start, x.end) for x in value(spark, S.span_candidates(s, e, 2, 2))] == [(1, 1), (0, 1)]
    assert value(spark, S.n_best(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)), 2)) == [1, 2]


def test_entities_and_overlaps(spark):
    t = spark.createDataFrame([(1, 0, "B-PER", "Ann", 0.5), (1, 1, "I-PER", "Lee", 0.7), (1, 2, "B-PER", "Bo", 0.9)], "k int, i int, tag string, w string, s double")
    got = [(r.words, r.score) for r in S.entity_groups(t, ["k"], "i", "tag", "w", "s").orderBy("start").collect()]
    assert got == [("Ann Lee", 0.6), ("Bo", 0.9)]
    o = spark.createDataFrame([(1, 0, 4, 0.5, "a"), (1, 2, 8, 0.4, "b"), (1, 8, 9, 0.1, "c"), (1, 8, 9, 0.2, "d")], "k int, s int, e int, sc double, l string")
    assert [r.label for r in S.resolve_overlaps(o, ["k"], "s", "e", "sc", "l").orderBy("start").collect()] == ["b", "d"]


def test_cumulative_means():
    assert list(S.cumulative_means([[1, 3], [5, 7]])) == [2.0, 4.0]
    assert list(S.cumulative_means([[1, 3], [5, 7]], compat=True)) == [2.0, 6.0]


def test_wordpieces_and_bpe():
    assert P.wordpieces("unaffable", frozenset(["un", "##aff", "##able"])) == ["un", "##aff", "##able"]
    assert P.wordpieces("xyz", frozenset(["x"])) == ["[UNK]"]
    assert P.merge_pairs(list("aabab"), {("a", "b"): 0, ("a", "ab"): 1}) == ["aab", "ab"]
    letters = P.byte_letters()
    assert len(set(letters.values())) == 256 and letters[32] == chr(288)


@pytest.mark.parametrize(
    "said, digits",
    [("two hundred and five cats", "205 cats"), ("twenty first", "21st"), ("nineteen eighty four", "1984"), ("three point one four", "3.14"), ("five dollars", "$5"), ("ten percent", "10%"), ("two million three thousand and one", "2003001"), ("no numbers", "no numbers"), ("one oh one", "101"), ("double seven", "77"), ("triple oh seven", "0007"), ("minus five", "-5"), ("five dollars and seven cents", "$5 and ¢7"), ("twenty five per cent", "25%"), ("two point five million", "2500000"), ("nineteen sixties", "1960s"), ("twenty one two", "212"), ("minus", "minus"), ("fifty point x", "50 point x"), ("$20 million", "$20000000"), ("1 . 5", "1 . 5")],
)
def test_digits_of_words(said, digits):
    assert A.digits_of_words(said) == digits


@pytest.mark.parametrize(
    "text, said",
    [("$5.50", "five dollars, fifty cents"), ("1,234", "one thousand, two hundred thirty-four"), ("21st", "twenty-first"), ("in 1984", "in one thousand, nine hundred eighty-four"), ("in 1900", "in nineteen hundred"), ("2005", "two thousand five"), ("3.5", "three point five"), ("3.14", "three point fourteen"), ("£1,000", "one thousand pounds"), ("$.50", "fifty cents"), ("$1.2.3", "one point two.three dollars"), ("$0", "zero dollars"), ("1" * 20, "number out of range")],
)
def test_spell_numbers(text, said):
    assert A.spell_numbers(text) == said


def test_speak_numbers():
    assert A.speak_numbers("-5 and 20% of $3") == "minus five and twenty percent of three dollars"


def test_chains_over_numbers():
    assert A.speak_numbers("1,234.50 and 105") == "one thousand two hundred and thirty four point five zero and one hundred and five"
    assert A.speech_text('Dr. “X” paid\n$5.50 on the 21st, "ok"') == "doctor x paid five dollars, fifty cents on the twenty-onest, ok"
    assert A.normalized_numbers("five dollars and seven cents") == "$5.07" and A.normalized_numbers("two and a half") == "2.5"
    said = "Mr. O'Neil's son wasn't there [noise] (laughs), um, he'd been to twenty first street; it's 5,000 % of $3 – naïve œuvre"
    assert N.english_normalized(said).split() == "mister o'neil is son was not there he had been to 21st street it is 5000 of $3 naive oeuvre".replace("o'neil", "0 neil").split()
    assert N.english_normalized("The colour of grey", {"colour": "color", "grey": "gray"}) == "the color of gray"


def test_numbers_of_any_length():
    """No text makes the number functions fail, whatever figures and number words it has."""
    import random

    rng = random.Random(2)
    lexicon = [*A.LEXICON, "2.0", "0.5", "3", "$7", "-1", "¢5", "1,234", ".5", "$1.2.3", "x", "9" * 5000, "21st", "and a half", "²", "٣", "1.", "%"]
    for _ in range(3000):
        text = " ".join(rng.choice(lexicon) for _ in range(rng.randrange(12)))
        for f in (A.normalized_numbers, A.spell_numbers, A.speak_numbers, A.speech_text, N.english_normalized):
            assert isinstance(f(text), str)
    assert A.digits_of_words("2.0 x") == "2 x" and A.digits_of_words(" ".join(["one"] * 6000) + " hundred").endswith(" 100")


def test_pieces_of_arrays(spark):
    rows = [(["unaffable", "aff", "x", None, ""],), (None,), ([],), (["unaffable"] * 3,)]
    df = spark.createDataFrame(rows, "w array<string>").coalesce(1)
    got = [r[0] for r in df.select(P.wordpiece_udf(["un", "##aff", "##able", "aff"])("w")).collect()]
    one = ["un", "##aff", "##able"]
    assert got == [[*one, "aff", "[UNK]"], None, [], one * 3]
    assert [r[0] for r in df.where("w is not null").select(P.byte_bpe_udf({("a", "b"): 0})(F.array(F.lit("aab"), F.lit("é")))).collect()][0] == ["a", "ab", "Ã", "©"]


def test_number_rules():
    assert A.number_rules_before("two and a half b2 1st") == "two point five b 2 1st"
    assert A.number_rules_after("$2 and ¢7, $0.07, 1") == "$2.07, ¢7, one"


def test_truncate_repetitions():
    unit = "a sentence that is long enough to count. "
    assert P.truncate_repetitions("start " + unit * 4) == "start " + unit.rstrip()
    assert P.truncate_repetitions("short short short") == "short short short"
    import random

    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("ab") for _ in range(rng.randrange(40))) + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))) * rng.randrange(1, 8)
        n = len(t)
        slow = max((r for r in range(2, n // 2) if t[n - 2 * r : n - r] == t[n - r :]), default=0)
        assert P._longest_square(t, 2) == (slow if n >= 4 else 0)


def test_line_runs_and_documents():
    assert P.similar_line_runs(["same line"] * 20 + ["other"]) == [(0, 19)]
    assert P.similar_line_runs(["same line"] * 15 + ["other"]) == []
    assert P.similar_line_runs(["x"] + ["same line", ""] * 10 + ["end line"]) == [(1, 19)]
    assert P.similar_line_runs(["same line"] * 10 + ["other one", "same line"] + ["same line"] * 9) == [(0, 20)]  # two runs near each other
    assert P.similar_line_runs(["[MISSING_PAGE 1]"] * 30) == []
    assert P.indel_ratio("abcd", "abce") == 0.75
    made_up = "a\n## References\n\n" + "".join(f"* [{k}] Author, Title of it, {1900 + k}.\n" for k in range(20)) + "tail"
    assert P.drop_repeated_references(made_up) == "a\n\n\n[MISSING_PAGE_POST]\n\n\ntail"
    assert P.drop_repeated_references("plain\n## References\n* [1] A\n* [2] Quite another") == "plain\n## References\n* [1] A\n* [2] Quite another"
    assert P.correct_tables("a\n" + "&" * 500 + "\nb") == "a\n\nb"
    assert P.correct_tables("\\begin{table} \\begin{tabular}{l l} & \\ \\end{tabular} \\end{table} Tab") == "\\begin{table}\n\\begin{tabular}{l l} & \\ \\end{tabular}\n\\end{table}\nTab"
    assert P.correct_tables("see \\begin{tabular}{l}") == "see \n\\begin{tabular}{l}"
    assert P.normalize_lists("- a b - 1.1 c d") == "- a b\n\t- 1.1 c d"
    assert P.normalize_lists("* one two * i.v three") == "* one two\n\t* i.v three"
    assert P.normalize_lists("no list - here * there") == "no list - here * there"
    page = "# 12\n" + "Some text of _x_ here.\n\n\n\n.\nFootnote 1: thanks: me\n\n" + "* [1][]Name\n" + "# Lost heading"
    assert P.clean_document(page) == "\nSome text of \\(x\\) here.\n\nFootnote 1: me\n\n* [1]Name "


def test_final_text():
    assert P.final_text("steve smith", "Steve Smith's book") == "Steve Smith"
    assert P.final_text("absent", "Steve") == "Steve"


def test_html_nodes():
    assert [x for _, x in P.html_nodes("<html><body><p>a</p><p>b</p></body></html>")] == ["/html/body/p[1]", "/html/body/p[2]"]
    assert P.html_nodes("<p>a &amp; b<br>c</p>") == [("a & b", "/p"), ("c", "/p")]
    assert P.html_nodes("") == []


def test_spectra():
    import numpy as np

    wave = np.sin(2 * np.pi * 8 * np.arange(64) / 64)
    assert P.spectrogram(wave, 64, 64)[0].argmax() == 8
    assert P.fft_length(400) == 512 and P.mel_filters(257, 80, 0, 8000, 16000).shape == (257, 80)
    assert P.chroma_filters(257, 12, 16000).shape == (257, 12)


def test_nested_and_suppressed():
    import pandas as pd

    s = pd.DataFrame({"start": [0, 1, 5], "end": [4, 2, 6], "score": [3.0, 2.0, 1.0]})
    assert S.best_spans(s, 2).start.tolist() == [0, 5]
    b = pd.DataFrame({"x0": [0.0, 1, 20], "y0": [0.0, 0, 0], "x1": [10.0, 11, 30], "y1": [10.0, 10, 10], "score": [0.9, 0.8, 0.1]})
    assert S.suppress_overlapping(b).score.tolist() == [0.9, 0.1]


def test_word_flush():
    assert L.word_flush("", "hel") == ("", "hel") and L.word_flush("hel", "lo wor") == ("hello ", "wor")
    assert L.word_flush("a", "b\n") == ("ab\n", "") and L.word_flush("", "你") == ("你", "") and L.word_flush("x", "", True) == ("x", "")


def test_timestamp_rules():
    import math

    out = L.timestamp_rules([0.0] * 6, [4, 5], first=4, end=3)
    assert all(math.isinf(x) for x in out[4:]) and out[0] == 0.0
    assert all(math.isinf(x) for x in L.timestamp_rules([0.0] * 6, [1, 4], first=4, end=3)[:3])


def test_asof_and_range_join(spark):
    from tessella.operators import joins as J

    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3)], "k string, t long")
    right = spark.createDataFrame([("a", 1, 10.0), ("a", 4, 40.0), ("b", 9, 90.0)], "k string, t long, v double")
    assert {(r.k, r.t): r.v for r in J.asof_join(left, right, "k", "t", "v").collect()} == {("a", 1): 10.0, ("a", 5): 40.0, ("b", 3): None}
    p = spark.createDataFrame([(0.5,), (9.9,), (10.0,)], "x double")
    r = spark.createDataFrame([(0.0, 10.0), (9.0, 12.0), (3.0, 3.0)], "lo double, hi double")
    assert sorted((a.x, a.lo) for a in J.range_join(p, r, "x", "lo", "hi", 4.0).collect()) == [(0.5, 0.0), (9.9, 0.0), (9.9, 9.0), (10.0, 9.0)]


def test_callbacks(spark, tmp_path):
    from tessella.operators import mapping as M

    df = spark.createDataFrame([(1, "a"), (2, "b")], "n long, s string")
    assert [r.s for r in M.filter_rows(df, lambda pdf: pdf.n > 1).collect()] == ["b"]
    assert sorted(r.m for r in M.map_rows(df, lambda r: {"m": r["n"] * 2}, "m long").collect()) == [2, 4]
    df.write.parquet(str(tmp_path / "in.parquet"))
    M.run_files(spark, str(tmp_path / "in.parquet"), str(tmp_path / "out"), lambda pdf: pdf[["n"]], "n long")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_blocks_of_queries_find_the_same(spark, monkeypatch):
    import random

    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(["the"] + [rng.choice(vocabulary) for _ in range(n)])
    docs = spark.createDataFrame([(k, text(rng.randrange(30))) for k in range(700)] + [(900, None), (901, ""), (None, "w1"), (902, "other words")], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(k, text(4)) for k in range(20)] + [(50, None), (None, "w1"), (51, "unknown"), (3, "w5")], "item_id long, text string")
    whole = sorted(map(tuple, R.bm25(asked, docs, 4).collect()))
    assert len(whole) == 80 and not any(r[0] == 51 for r in whole)
    monkeypatch.setattr(R, "BM25_BLOCK", 7)
    monkeypatch.setattr(R, "BM25_STEP", 50)
    assert sorted(map(tuple, R.bm25(asked, docs, 4).collect())) == whole
    assert R.bm25(asked.limit(0), docs, 4).count() == 0 and R.bm25(asked, docs.limit(0), 4).count() == 0
    vectors = spark.createDataFrame([(k, [rng.random() for _ in range(4)]) for k in range(90)], "vec_id long, embedding array<double>")
    near = sorted(map(tuple, R.knn(vectors, vectors, 3).collect()))
    monkeypatch.setattr(R, "QUERY_BLOCK", 25)
    assert sorted(map(tuple, R.knn(vectors, vectors, 3).collect())) == near and len(near) == 270


def test_runs_of_words_are_dealt_by_their_first_two(spark):
    """One row a place is shuffled, for all runs that begin there; frequent beginnings and short texts give the same counts."""
    from collections import Counter

    from tessella.plans.corpus import _ngrams

    texts = [f"{i} p q r p q" for i in range(8000)] + [None, "", "one", "two words", "a b c d e f g h", "a b c d e f g h"]
    got = _ngrams(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = Counter((" ".join(w[i : i + n]), n) for t in texts if t for w in [t.split()] for n in range(2, 8) for i in range(len(w) - n + 1))
    assert {(r.ngram, r.n): r.cnt for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(head" in plan


def test_runs_of_words_are_counted_in_one_pass_over_sorted_rows(spark):
    """all six lengths of a sorted row at once, over the bounds of batches, whatever bytes the words hold; the greatest counts with their ties."""
    import random
    from collections import Counter

    from tessella.operators import phrases as P

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "a\x00", "a\x01b", "b", "\u00e9", "\U0001f600"]) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "often seen " * 150]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    want = Counter((" ".join(w[i : i + n]), n) for t in texts if t for w in [t.split(" ")] for n in range(2, 8) for i in range(len(w) - n + 1) if all(w))
    want.update((" ".join(w[i : i + n]), n) for w in [texts[-1].split()] for n in range(2, 8) for i in range(len(w) - n + 1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = P.phrase_counts(docs, F.split(F.btrim("text"), " "))
        assert {(r.ngram, r.n): r.cnt for r in got.collect()} == want and got.count() == len(want)
        most = {(r.ngram, r.n): r.cnt for r in P.phrase_counts(docs, F.split(F.btrim("text"), " "), 9).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    least = sorted(want.values())[-9]
    assert {k for k, n in want.items() if n >= least} <= set(most) and all(want[k] == n for k, n in most.items()) and len(most) < len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Sort [head" in plan and "explode" not in plan


def test_best_of_rows_with_ties(monkeypatch):
    """Ties go by id however many there are, and only candidates are sorted."""
    import numpy as np

    from tessella.operators import retrieval

    rng = np.random.default_rng(2)
    score, pid = rng.integers(0, 40, (30, 500)).astype(float), np.broadcast_to(rng.permutation(500), (30, 500))
    score[0] = 7.0
    score[1, 3:] = -np.inf
    for sign in (1, -1):
        order = np.lexsort((pid, sign * score), axis=1)[:, :5]
        got = retrieval._best(score, pid, 5, sign)
        assert (got[1] == np.take_along_axis(pid, order, 1)).all() and (got[0] == np.take_along_axis(score, order, 1)).all()
    widths, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, axis: widths.append(keys[1].shape[1]) or lexsort(keys, axis=axis))
    retrieval._best(rng.normal(size=(9, 4000)), np.broadcast_to(np.arange(4000), (9, 4000)), 3, -1)
    assert widths == [3]


def test_word_error_rate_cuts_each_text_into_words_once(spark):
    """the words that a lambda looks into are a value, not made anew for each word."""
    df = spark.createDataFrame([("a b a", "a c a"), (None, "x"), ("x", None)], "r string, p string").select(E.word_error_rate(F.col("r"), F.col("p")).alias("w"))
    assert [r.w for r in df.collect()] == [pytest.approx(1 / 3), None, None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
