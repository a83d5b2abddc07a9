"""Answers against the rule in plain Python."""

import math
import random

from pyspark.sql import functions as F

from tessella.operators import answers as A

SCHEMA = "id long, feature int, tokens array<string>, is_max array<boolean>, start_logits array<double>, end_logits array<double>"


def by_hand(rows, n, longest, threshold, with_null=True):
    lists, predictions = {}, {}
    for i in sorted({r[0] for r in rows}):
        spans, null = [], None
        for _, f, tokens, is_max, start, end in sorted(r for r in rows if r[0] == i):
            order = lambda x: sorted(range(len(x)), key=lambda k: (-x[k], k))[:n]
            null = min(null or (math.inf,), (start[0] + end[0], f, start[0], end[0]))
            for a, s in enumerate(order(start)):
                for b, e in enumerate(order(end)):
                    if 0 < s < len(tokens) and s <= e < len(tokens) and e - s < longest and is_max[s]:
                        spans.append((-(start[s] + end[e]), f, a, b, start[s], end[e], " ".join(tokens[s : e + 1])))
        if with_null:
            spans.append((-null[0], math.inf, 0, 0, null[2], null[3], ""))
        best, seen = [], set()
        for x in sorted(spans):
            if x[6] not in seen and (len(best) < n or x[6] == ""):
                best.append(x)
                seen.add(x[6])
        if not any(x[6] for x in best):
            best.insert(0, (0, 0, 0, 0, 0.0, 0.0, A.NO_ANSWER))
        weights = [math.exp(x[4] + x[5]) for x in best]
        lists[i] = [(x[6], round(w / sum(weights), 6)) for x, w in zip(best, weights)]
        top = next(x for x in best if x[6])
        predictions[i] = "" if with_null and null[0] - top[4] - top[5] > threshold else top[6]
    return lists, predictions


def test_answers_equal_the_rule(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        for f in range(rng.randint(1, 3)):
            size = rng.choice([0, 1, 5, 12])
            tokens = ["[CLS]", *(rng.choice("abc") for _ in range(size))]
            logit = lambda: [float(rng.randint(-2, 3)) for _ in range(size + 1 + rng.choice([0, 2]))]  # noqa: B023, E731  padding behind, ties
            rows.append((i, f, tokens, [False, *(rng.random() < 0.7 for _ in range(size))], logit(), logit()))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.lit(1)).withColumn("rank", F.lit(2))
    for n, longest, with_null in ((3, 2, True), (8, 12, True), (4, 3, False)):
        listed, predicted = A.answers(df, n, longest, with_null, threshold=0.5)
        lists, predictions = by_hand(rows, n, longest, 0.5, with_null)
        got = {}
        for r in listed.orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append((r.text, round(r.probability, 6)))
        assert got == lists
        # who has nothing but the empty answer stands in the lists as "empty"
        assert {r.id: r.prediction for r in predicted.collect()} == predictions
    assert [t.count() for t in A.answers(df.limit(0))] == [0, 0]


def test_features_show_each_word_once_at_its_best(spark):
    docs = spark.createDataFrame([(1, [f"w{k}" for k in range(150)]), (2, ["one"]), (3, []), (4, None), (5, [f"x{k}" for k in range(64)])], "doc_id long, words array<string>")
    rows = A.context_features(docs, "doc_id", "words", 64, 32).collect()
    best = {}
    for r in rows:
        assert r.tokens[0] == "[CLS]" and not r.is_max[0] and len(r.tokens) == len(r.is_max) <= 65
        for k, m in enumerate(r.is_max[1:]):
            if m:
                assert best.setdefault((r.id, 32 * r.feature + k), r.feature) == r.feature
    assert sorted(best) == sorted([(1, k) for k in range(150)] + [(2, 0)] + [(5, k) for k in range(64)])
    for (i, k), f in best.items():
        n = {1: 150, 2: 1, 5: 64}[i]
        score = {g: min(k - 32 * g, min(64, n - 32 * g) - 1 - k + 32 * g) + 0.01 * min(64, n - 32 * g) for g in range(4) if 0 <= k - 32 * g < min(64, n - 32 * g) and (g == 0 or 32 * (g - 1) + 64 < n)}
        assert score[f] == max(score.values())


def test_a_window_carries_only_its_own_words(spark):
    """no copy of the whole text for each of its windows."""
    docs = spark.createDataFrame([(1, ["w"] * 300)], "doc_id long, words array<string>")
    plan = A.context_features(docs, "doc_id", "words", 64, 32)._jdf.queryExecution().executedPlan().toString()
    kept = [x.split("), [")[1].split("]")[0] for x in plan.splitlines() if "Generate explode" in x]
    assert len(kept) == 1 and "_w#" not in kept[0]


def test_neither_tokens_nor_logits_are_stored_or_shuffled(spark, monkeypatch):
    """what a task finds is cut to each example's best before it is stored, and lists and predictions are the same however features are dealt."""
    rng = random.Random(5)
    rows = []
    for i in range(12):
        for f in range(rng.randint(1, 9)):
            size = rng.choice([1, 5, 12])
            logit = lambda: [float(rng.randint(-2, 3)) for _ in range(size + 1)]  # noqa: B023, E731
            rows.append((i, f, ["[CLS]", *(rng.choice(["a", "b", ""]) for _ in range(size))], [False, *(rng.random() < 0.7 for _ in range(size))], logit(), logit()))
    rng.shuffle(rows)
    kept, stored = [], A.stored
    monkeypatch.setattr(A, "stored", lambda df, name: kept.append(df) or stored(df, name))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        listed, predicted = A.answers(spark.createDataFrame(rows, SCHEMA), 4, 3, True, threshold=0.5)
        got = {}
        for r in listed.orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append((r.text, round(r.probability, 6)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lists, predictions = by_hand(rows, 4, 3, 0.5)
    assert got == lists and {r.id: r.prediction for r in predicted.collect()} == predictions
    assert kept and not any("array" in kind for df in kept for _, kind in df.dtypes)
    assert "Exchange" not in kept[0]._jdf.queryExecution().executedPlan().toString()


def test_features_with_a_narrow_stride_and_their_results(spark):
    docs = spark.createDataFrame([(k, [f"w{j}" for j in range(k)]) for k in (1, 9, 10, 11, 37)], "doc_id long, words array<string>")
    features = A.context_features(docs, "doc_id", "words", 10, 3)
    shown = {}
    for r in features.collect():
        count = max(math.ceil((r.id - 10) / 3), 0) + 1
        for k, m in enumerate(r.is_max[1:], 3 * r.feature):
            score = {g: min(k - 3 * g, min(10, r.id - 3 * g) - 1 - k + 3 * g) + 0.01 * min(10, r.id - 3 * g) for g in range(count) if 0 <= k - 3 * g < min(10, r.id - 3 * g)}
            assert m == (max(score, key=lambda g: (score[g], -g)) == r.feature)
            shown.setdefault(r.id, []).extend([k] * m)
    assert all(sorted(x) == list(range(i)) for i, x in shown.items()) and len(shown) == 5
    results = features.where("id = 37").select("id", "feature", F.array(F.lit(1.0)).alias("start_logits"), F.array(F.lit(2.0)).alias("end_logits"))
    assert A.feature_results(features, results).count() == features.where("id = 37").count() == 10
