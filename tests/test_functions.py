"""Hand-computed cases of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import chat as C
from tessella.functions import decode as D
from tessella.functions import text as T
from tessella.functions import vector as V
from tessella.functions.english import english_normalized


def value(spark, expr, **cells):
    df = spark.createDataFrame([tuple(cells.values())], list(cells)) if cells else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, clean",
    [("The  Cat, a dog!", "cat dog"), ("an", ""), ("", ""), ("Theater", "theater"), ("a.b", "ab"), ("É the É", "é é")],
)
def test_normalize_answer(spark, raw, clean):
    assert value(spark, T.normalize_answer(F.col("t")), t=raw) == clean


def test_null_answers(spark):
    df = spark.createDataFrame([(None, "x")], "p string, g string")
    row = df.select(T.normalize_answer(F.col("p")).alias("n"), T.exact_match(F.col("p"), F.col("g")).alias("e"), T.token_f1(F.col("p"), F.col("g"))["f1"].alias("f")).first()
    assert tuple(row) == ("", 0, 0.0)


@pytest.mark.parametrize(
    "p, g, f1, precision, recall",
    [("cat sat", "cat", 2 / 3, 0.5, 1.0), ("b b c", "b c c", 2 / 3, 2 / 3, 2 / 3), ("yes", "yes indeed", 0, 0, 0), ("the", "a", 0, 0, 0), ("x", "y", 0, 0, 0), ("yes", "Yes!", 1, 1, 1)],
)
def test_token_f1(spark, p, g, f1, precision, recall):
    got = value(spark, T.token_f1(F.col("p"), F.col("g")), p=p, g=g)
    assert tuple(got) == pytest.approx((f1, precision, recall))


def test_token_f1_with_empty(spark):
    f = lambda p, g: value(spark, T.token_f1_with_empty(F.col("p"), F.col("g")), p=p, g=g)
    assert f("the", "a") == 1.0 and f("the", "cat") == 0.0 and f("cat sat", "cat") == pytest.approx(2 / 3)


def test_exact_match_of_empty(spark):
    assert value(spark, T.exact_match(F.col("p"), F.col("g")), p="the", g="a") == 1


def test_ngrams(spark):
    w = F.split(F.lit("a b c"), " ")
    assert [value(spark, T.ngrams(w, n)) for n in (2, 3, 4)] == [["a b", "b c"], ["a b c"], []]


def test_symbol_pairs(spark):
    assert value(spark, T.symbol_pairs(F.array(*map(F.lit, "abab")))) == ["a b", "b a"]
    assert value(spark, T.symbol_pairs(F.array(F.lit("a")))) == []


def test_clean_and_split(spark):
    assert value(spark, T.clean_control(F.lit("a\x00b\tc�d"))) == "ab cd"
    assert value(spark, T.space_chinese(F.lit("ab你c"))) == "ab 你 c"
    assert value(spark, T.basic_tokens(F.lit("Ça va? 你好—x_y"))) == ["ca", "va", "?", "你", "好", "—", "x", "_", "y"]
    assert value(spark, T.strip_accents(F.lit("Àé ñ"))) == "Ae n"


def test_multilingual(spark):
    assert value(spark, T.normalize_multilingual(F.lit("Hello <tag> (aside) [x] wörld!"))) == "hello wörld "


def test_english_normalized():
    assert english_normalized("Mr. Smith won't pay $1,000, uh, I've said [noise]").split() == "mister smith will not pay $1000 i have said".split()


def test_abbreviations_and_ascii(spark):
    assert value(spark, T.expand_abbreviations(F.lit("Mr. and DR. Who"))) == "mister and doctor Who"
    assert value(spark, T.ascii_only(F.lit("naïve"))) == "nave"


def test_markdown(spark):
    assert value(spark, T.markdown_compatible(F.lit("see https://a.example.org/x now"))) == "see [https://a.example.org/x](https://a.example.org/x) now"


def test_rag_prompt(spark):
    assert value(spark, T.rag_prompt("", F.lit('"T"'), F.lit("x"), F.lit("q"))) == "T / x // q"


def test_char_word_index(spark):
    assert value(spark, T.char_word_index(F.lit(" ab c"))) == [-1, 0, 0, 0, 1]


def test_camel_and_sublists(spark):
    assert value(spark, T.camel_words(F.lit("myHTTPServerX"))) == ["my", "HTTP", "Server", "X"]
    a = F.array(*map(F.lit, [1, 2, 1, 2, 1]))
    assert value(spark, T.sublist_starts(a, F.array(F.lit(1), F.lit(2)))) == [0, 2]


def test_rounded_keeps_the_sign_of_zero(spark):
    got = [value(spark, V.rounded("x", 6), x=x) for x in (-4e-7, -0.0, 0.0, 4e-7, -6e-7, -2.5)]
    assert [repr(x) for x in got] == ["-0.0", "-0.0", "0.0", "0.0", "-1e-06", "-2.5"]
    assert value(spark, V.rounded(F.lit(None).cast("double"), 6)) is None and math.isnan(value(spark, V.rounded(F.lit(float("nan")), 6)))


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(0.0))
    assert value(spark, V.dot(a, b)) == 3.0 and value(spark, V.squared_distance(a, b)) == 20.0
    assert value(spark, V.l2_normalize(a)) == [0.6, 0.8]
    assert all(math.isnan(x) for x in value(spark, V.l2_normalize(F.array(F.lit(0.0)))))
    assert value(spark, V.softmax(F.array(F.lit(1.0), F.lit(1.0)))) == [0.5, 0.5]


def test_pooling(spark):
    v = F.array(F.array(F.lit(1.0)), F.array(F.lit(4.0)))
    mask = F.array(F.lit(1), F.lit(1))
    assert value(spark, V.mean_pool(v, mask)) == [2.5] and value(spark, V.mean_pool(v, mask, weighted=True)) == [3.0]
    assert value(spark, V.mean_pool(v, F.array(F.lit(1), F.lit(0)))) == [1.0]


def test_stride_slice(spark):
    assert value(spark, V.stride_slice(F.sequence(F.lit(0), F.lit(49)), 10)) == [0, 10, 20, 30, 40]


def test_boxes(spark):
    box = lambda *x: F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(x, ("x0", "y0", "x1", "y1"))])
    assert value(spark, V.iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert tuple(value(spark, V.patch_index(F.lit(0.1), F.lit(0.1), F.lit(0.3), F.lit(0.3), 10))) == (11, 22)
    assert tuple(value(spark, V.patch_box(F.lit(0), F.lit(0), 2))) == (0.0, 0.0, 0.5, 0.5)
    assert tuple(value(spark, V.patch_box(F.lit(0), F.lit(3), 2))) == (0.25, 0.25, 0.75, 0.75)
    with pytest.raises(Exception, match="x1 > x0"):
        value(spark, V.patch_index(F.lit(0.5), F.lit(0.1), F.lit(0.3), F.lit(0.3), 10))


@pytest.mark.parametrize("scale", [V.HTK, V.KALDI, V.SLANEY])
def test_mel_inverse(spark, scale):
    for hz in (100.0, 999.0, 4000.0):
        assert value(spark, V.mel_to_hertz(V.hertz_to_mel(F.lit(hz), scale), scale)) == pytest.approx(hz)


def test_signal_windows(spark):
    assert value(spark, V.signal_window(4, "hann")) == pytest.approx([0, 0.5, 1, 0.5])
    assert value(spark, V.signal_window(2, "boxcar")) == [1.0, 1.0]


def test_colors(spark):
    assert tuple(value(spark, V.id_to_rgb(V.rgb_to_id(F.lit(1), F.lit(2), F.lit(3))))) == (1, 2, 3)


def probs(spark):
    return spark.createDataFrame([("q", 0, math.log(0.5)), ("q", 1, math.log(0.3)), ("q", 2, math.log(0.2))], "g string, t int, x double")


def test_top_p_boundary(spark):
    """A token after exactly p stays only where the boundary is inclusive."""
    assert D.top_p(probs(spark), "g", "t", "x", 0.5).count() == 2
    assert D.top_p(probs(spark), "g", "t", "x", 0.5, inclusive=False).count() == 1


def test_top_k_keeps_ties(spark):
    df = spark.createDataFrame([("q", k, x) for k, x in enumerate([3.0, 2.0, 2.0, 1.0])], "g string, t int, x double")
    assert D.top_k(df, "g", "x", 2).count() == 3


def test_repetition_penalty(spark):
    df = spark.createDataFrame([("q", 0, 2.0), ("q", 1, -2.0), ("q", 2, 2.0)], "g string, t int, x double")
    seen = df.where("t < 2").select("g", "t")
    assert [r.x for r in D.repetition_penalty(df, seen, "g", "t", "x", 2.0).orderBy("t").collect()] == [1.0, -4.0, 2.0]


def ids(*x):
    return F.array(*[F.lit(v).cast("bigint") for v in x])


def test_bans(spark):
    assert value(spark, D.banned_by_ngram(ids(1, 2, 3, 1, 2), 3)) == [3]
    assert value(spark, D.banned_by_ngram(ids(1), 3)) == []
    assert value(spark, D.banned_words(ids(5, 1), [[1, 2], [9], [7, 1, 4]])) == [2, 9]


def test_prompt_lookup(spark):
    assert value(spark, D.prompt_lookup(ids(1, 2, 3, 4, 1, 2), 2, 2)) == [3, 4]
    assert value(spark, D.prompt_lookup(ids(1, 2, 3), 2, 2)) == []


def messages(*pairs):
    return F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in pairs])


def test_instruction_prompt(spark):
    m = messages(("system", "S"), ("user", " hi "), ("assistant", "yo"), ("user", "x"))
    assert value(spark, C.render_instructions(m)) == "<s>[INST] <<SYS>>\nS\n<</SYS>>\n\n hi [/INST] yo </s><s>[INST] x [/INST]"
    assert value(spark, C.render_instructions(messages(("assistant", "a")))) is None
    with pytest.raises(Exception, match="alternate"):
        value(spark, C.render_instructions(messages(("user", "a"), ("user", "b")), strict=True))


def test_views(spark):
    v = value(spark, C.views(messages(("user", "a"), ("assistant", "b"), ("user", "c"))))
    assert (v.past_user_inputs, v.generated_responses) == (["a"], ["b"])


def test_text_functions_hold_a_bounded_part_of_a_batch(spark, monkeypatch):
    """Rows of a batch go through Python in runs of bounded bytes; a longer row is a run of its own, nulls and empty rows are kept."""
    import pyarrow as pa

    from tessella.functions import procedural as P

    monkeypatch.setattr(P, "STEP_BYTES", 10)
    texts = pa.array(["abcd", None, "", "efghij", "k" * 30, "l"])
    runs = [r.to_pylist() for r in P.text_slices(texts)]
    assert runs == [["abcd", None, "", "efghij"], ["k" * 30], ["l"]]
    assert list(P.text_slices(texts.slice(0, 0))) == []
    cut = P.byte_bpe_udf({}).func
    monkeypatch.setattr(P, "STEP_WORDS", 2)
    got = list(cut(iter([pa.array([["ab", "c"], None, [], ["d", None, "ef"]], pa.list_(pa.string()))])))
    assert len(got) == 2 and [x for g in got for x in g.to_pylist()] == [["a", "b", "c"], None, [], ["d", "e", "f"]]


def test_ids_are_made_once_a_row(spark):
    """what is searched for the last ids is a value, not made anew for each place."""
    rows = spark.range(3).select(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.pmod(i * F.col("id") + 77, F.lit(3)).cast("long")).alias("ids"))
    for made in (D.prompt_lookup(F.col("ids"), 2, 3), D.banned_by_ngram(F.col("ids"), 3)):
        assert rows.select(made.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("77") == 1
    assert value(spark, D.prompt_lookup(F.lit(None).cast("array<bigint>"), 2, 2)) == []
    assert value(spark, D.banned_by_ngram(ids(1, 2, 3, 1, 2), 3)) == [3]
