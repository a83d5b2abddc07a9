import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators import pairs
from tessella.plans.config import Settings
from tessella.plans.registry import query
from tessella.sources import readers as R
from tessella.sources import sinks as W
from tessella.streaming import streams as L


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_tsv_with_byte_order_mark(spark, tmp_path):
    p = write(tmp_path / "a.tsv", '﻿1\t"x\n2\ty"\n')
    assert [tuple(r) for r in R.read_tsv(spark, p, "pid STRING, text STRING").collect()] == [("1", '"x'), ("2", 'y"')]


def test_task_readers(spark, tmp_path):
    p = write(tmp_path / "train.tsv", "h\th\th\th\th\n1\ta\tb\tone\ttwo\n0\ta\tb\tshort\n")
    assert [tuple(r) for r in R.read_task(spark, "mrpc", p, "train").collect()] == [("train-1", "one", "two", "1")]
    c = write(tmp_path / "cola.tsv", "x\t1\t\tGood.\ny\t0\t*\tBad.\n")
    assert [(r.text_a, r.label) for r in R.read_task(spark, "cola", c, "train").collect()] == [("Good.", "1"), ("Bad.", "0")]
    s = write(tmp_path / "sts.tsv", "\t".join("abcdefghij") + "\n" + "\t".join(["7", "", "", "", "", "", "", "s1", "s2", "4.5"]) + "\n")
    assert R.read_task(spark, "sts-b", s, "train").first().label == 4.5
    with pytest.raises(KeyError):
        R.read_task(spark, "nothing", p, "train")


def test_csv_examples_and_xnli(spark, tmp_path):
    p = write(tmp_path / "e.tsv", "pos\tfine\nneg\tpoor\n")
    assert [tuple(r) for r in R.read_csv_examples(spark, p, "dev").collect()] == [("dev-0", "fine", None, "pos"), ("dev-1", "poor", None, "neg")]
    x = write(tmp_path / "x.tsv", "a\tb\tlabel\np\th\tcontradictory\n")
    assert R.read_xnli(spark, x, "train").first().label == "contradiction"
    t = write(tmp_path / "t.tsv", "\t".join("abcdefgh") + "\n" + "de\tneutral\t\t\t\t\tP\tH\nen\tneutral\t\t\t\t\tP2\tH2\n")
    assert [(r.text_a, r.text_b, r.label) for r in R.read_xnli(spark, t, "test", "de").collect()] == [("P", "H", "neutral")]


def test_label_map(spark):
    place = R.label_map(["a", "b"])
    df = spark.createDataFrame([("b",), (None,)], "l string")
    assert [r[0] for r in df.select(place(F.col("l"))).collect()] == [1, None]
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([("z",)], "l string").select(place(F.col("l"))).collect()


def test_nested_qa(spark, tmp_path):
    data = {"version": "1", "data": [{"title": "T", "paragraphs": [{"context": "C", "qas": [{"id": "1", "question": "Q", "answers": [{"text": "A", "answer_start": 3}, {"text": "B", "answer_start": 4}]}, {"id": "2", "question": "Q2", "is_impossible": True, "answers": []}]}]}]}
    p = write(tmp_path / "q.json", json.dumps(data))
    train = {r.id: (r.answer_text, r.is_impossible) for r in R.read_qa(spark, p, True).collect()}
    assert train == {"1": ("A", False), "2": (None, True)}
    assert {r.id: len(r.answers) for r in R.read_qa(spark, p, False).collect()} == {"1": 2, "2": 0}


def test_line_readers(spark, tmp_path):
    p = write(tmp_path / "l.txt", "one\n\n  \ntwo\nthree\n")
    assert [r.value for r in R.read_lines(spark, p).collect()] == ["one", "two", "three"]
    assert [(r.doc, r.line) for r in R.read_blank_separated(spark, p).orderBy("line_no").collect()] == [(0, "one"), (2, "two"), (2, "three")]
    d = write(tmp_path / "d.txt", '<doc id="1">\nTitle\n\nbody\n</doc>\nx\n<doc id="2">\nT2\nb2\n</doc>\n')
    assert [r.line for r in R.read_tagged_documents(spark, d).orderBy("line_no").collect()] == ["body", "b2"]


def test_lines_with_references(spark, tmp_path):
    a, b = write(tmp_path / "a.txt", "x\n\ny\n"), write(tmp_path / "b.txt", "[1]\n[2]\n")
    assert [(r.line, r.ref) for r in R.read_json_lines_with_refs(spark, a, b).orderBy("n").collect()] == [("x", "[1]"), ("y", "[2]")]
    with pytest.raises(Exception, match="differ in length"):
        R.read_json_lines_with_refs(spark, a, write(tmp_path / "c.txt", "[1]\n")).collect()


def test_vectors(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(6, dtype="float32").reshape(3, 2))
    assert [(r.vec_id, r.embedding) for r in R.read_any(spark, str(tmp_path / "v.npy")).orderBy("vec_id").collect()][1] == (1, [2.0, 3.0])
    np.save(tmp_path / "b.npy", np.array([b"ab", b"c"]))
    assert [bytes(r.block) for r in R.read_block_records(spark, str(tmp_path / "b.npy")).orderBy("block_id").collect()] == [b"ab", b"c"]
    t = write(tmp_path / "v.vec", "1.0 2.0\n3.0 4.0\n")
    assert R.read_text_vectors(spark, t, 2).count() == 2
    with pytest.raises(Exception, match="has not 3"):
        R.read_text_vectors(spark, t, 3).collect()


def test_formats_and_schema(spark, tmp_path):
    assert R.infer_format("x/y.jsonl") == "jsonl" and R.infer_format("") == "pipe"
    with pytest.raises(ValueError):
        R.infer_format("x.unknown")
    W.save_columnar(spark.range(3), str(tmp_path / "t"))
    R.read_columnar(spark, str(tmp_path / "t"), T.StructType([T.StructField("id", T.LongType())]))
    with pytest.raises(ValueError, match="missing"):
        R.read_columnar(spark, str(tmp_path / "t"), T.StructType([T.StructField("x", T.LongType())]))


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(5)], "doc_id long, text string").coalesce(1)
    W.save_json_lines(docs, str(tmp_path / "j"), "doc_id", "text", rows=2)
    assert len(list((tmp_path / "j").glob("part-*"))) == 3
    W.save_json_array(docs, str(tmp_path / "a"))
    assert R.read_json_array(spark, str(tmp_path / "a")).count() == 5
    W.save_json_lines(docs.limit(0), str(tmp_path / "e"), "doc_id", "text")
    assert spark.read.schema("id long").json(str(tmp_path / "e")).count() == 0
    built = []
    make = lambda: built.append(1) or docs
    assert W.cached_table(spark, str(tmp_path / "c"), make).count() == W.cached_table(spark, str(tmp_path / "c"), make).count() == 5
    assert built == [1]


def test_registry_and_settings():
    from tessella.plans import catalog  # noqa: F401  it registers the queries

    with pytest.raises(ValueError, match="twice"):
        query("knn_ip_topk")(lambda spark, d: None)
    s = Settings({"a": {"b": 1, "c": 2}})
    assert s.joined({"a": {"b": 5}}).a == {"b": 5, "c": 2} and s.a.b == 1
    with pytest.raises(AttributeError):
        s.nothing


def test_sentence_pairs(spark):
    docs = spark.createDataFrame([(k, "\n".join(f"line {k} {j} x" for j in range(30))) for k in range(20)], "doc_id long, text string")
    order = pairs.order_pairs(docs, words=12).collect()
    assert 0.35 < sum(r.swapped for r in order) / len(order) < 0.65
    nxt = pairs.next_pairs(docs, words=12).collect()
    assert 0.35 < sum(r.random for r in nxt) / len(nxt) < 0.75 and all(r.second for r in nxt)
    assert all(f"line {r.doc_id} " not in r.second for r in nxt if r.random)


def test_streamed_words_and_chunks(spark, tmp_path):
    rows = [("a", 0, "he", False), ("a", 1, "llo wo", False), ("a", 2, "rld", True), ("b", 0, "x", True)]
    spark.createDataFrame(rows, "stream_id string, seq int, piece string, is_last boolean").coalesce(1).write.parquet(str(tmp_path / "w"))
    out = L.drained(L.emit_words(L.replay(spark, str(tmp_path / "w")))).orderBy("stream_id", "seq").collect()
    assert [(r.stream_id, r.shown) for r in out] == [("a", "hello "), ("a", "world"), ("b", "x")]
    data = [(1, 0, bytearray(b"01234"), False), (1, 1, bytearray(b"56789"), True)]
    spark.createDataFrame(data, "stream_id long, seq int, piece binary, is_last boolean").coalesce(1).write.parquet(str(tmp_path / "c"))
    out = L.drained(L.emit_chunks(L.replay(spark, str(tmp_path / "c")), 6, 1, 1)).orderBy("chunk_no").collect()
    assert [(bytes(r.chunk), r.left, r.right) for r in out] == [(b"012345", 0, 1), (b"456789", 1, 1), (b"89", 1, 0)]


def test_streamed_words_of_sorted_rows_are_not_dealt_anew(spark, tmp_path):
    """Most keys come as one sorted frame, which is taken as it is; others are put in order; a key that shows nothing yet gives no rows."""
    import pandas as pd

    one, two = pd.DataFrame({"seq": [0, 1], "n": [5, 6]}), pd.DataFrame({"seq": [3, 2], "n": [8, 7]})
    assert L._ordered([one], "seq") is one
    assert L._ordered([two, one], "seq")["n"].tolist() == [5, 6, 7, 8]
    assert all(L._chinese(c) for c in "\u3400\u4dbf\u4e00\u9fff\uf900\ufaff\U00020000\U0002fa1f") and not any(L._chinese(c) for c in "a é\u33ff\u4dc0\uac00\uff01")
    rows = [("a", 2, "rld", True), ("a", 1, "llo wo", False), ("a", 0, "he", False), ("b", 0, "x", False), ("c", 0, "y\u4e00", False)]
    spark.createDataFrame(rows, "stream_id string, seq int, piece string, is_last boolean").coalesce(1).write.parquet(str(tmp_path / "w"))
    out = L.drained(L.emit_words(L.replay(spark, str(tmp_path / "w")))).orderBy("stream_id", "seq").collect()
    assert [(r.stream_id, r.seq, r.shown) for r in out] == [("a", 1, "hello "), ("a", 2, "world"), ("c", 0, "y\u4e00")]


def test_lines_of_split_files_have_the_numbers_of_the_whole(spark, tmp_path):
    """A file in many splits, lines longer than a split, carriage returns, documents across splits."""
    import random

    rng = random.Random(4)
    lines = [rng.choice(["", "x" * rng.randint(1, 900), "é\t" * 40, "<doc id=1>", "</doc>", "text\r"]) for _ in range(400)] + ["<doc id=9>", "title", "last"]
    (tmp_path / "a.txt").write_bytes("\n".join(lines).encode())
    (tmp_path / "b.txt").write_bytes(b"one\ntwo\n")
    plain = [x.removesuffix("\r") for x in lines]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = R.numbered_lines(spark, str(tmp_path)).collect()
        assert R._split_lines(spark, str(tmp_path / "a.txt")).select("block").distinct().count() > 4
        assert [r.line for r in sorted(got, key=lambda r: r.line_no) if r.file.endswith("a.txt")] == plain
        assert sorted((r.line_no, r.line) for r in got if r.file.endswith("b.txt")) == [(0, "one"), (1, "two")]
        doc, want = 0, []
        for k, x in enumerate(plain):
            doc += x == ""
            if x.strip(" "):
                want.append((k, x, doc))
        assert [(r.line_no, r.line, r.doc) for r in R.read_blank_separated(spark, str(tmp_path / "a.txt")).orderBy("line_no").collect()] == want
        opened = closed = 0
        want, first = [], {}
        for k, x in enumerate(plain):
            opened, closed = opened + ("<doc id=" in x), closed + ("</doc>" in x)
            if opened > closed and "<doc id=" not in x and x.strip(" "):
                if first.setdefault(opened, k) != k:
                    want.append((k, x, opened))
        assert [(r.line_no, r.line, r.doc) for r in R.read_tagged_documents(spark, str(tmp_path / "a.txt")).orderBy("line_no").collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
