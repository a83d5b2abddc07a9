"""Sources: delimited text, JSON, lines, documents, vectors, hits, benchmark task files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = False, quote: str | None = None) -> DataFrame:
    """Tab-separated text with the caller's names and types; a byte order mark is dropped. No quoting unless asked for."""
    df = spark.read.csv(path, sep="\t", schema=schema, header=header, quote=quote or "", encoding="UTF-8")
    first = df.columns[0]
    return df.withColumn(first, F.regexp_replace(first, "^﻿", "")) if dict(df.dtypes)[first] == "string" else df


def read_rows(spark: SparkSession, path: str, skip_header: bool = False) -> DataFrame:
    """row_no, cols: tab-separated lines as arrays, numbered from 0 within their file."""
    lines = numbered_lines(spark, path)
    rows = lines.select("file", F.col("line_no").alias("row_no"), F.split(F.regexp_replace("line", "^﻿|\r$", ""), "\t", -1).alias("cols"))
    return rows.where("row_no > 0").withColumn("row_no", F.col("row_no")) if skip_header else rows


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line_no, line. Files are read in splits, as Spark cuts them; a line's number is its place in its split and the lines of
    the splits before, of which there is one small row each."""
    placed = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", "\r$", "").alias("line"))
    heads = placed.groupBy("file", "block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("file").orderBy("block")) - F.col("_n")
    heads = heads.select("file", "block", (ahead - F.col("_first")).alias("_shift"))
    return placed.join(F.broadcast(heads), ["file", "block"]).select("file", "block", (F.col("_id") + F.col("_shift")).alias("line_no"), "line")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0), line, of files of any size: each split is a task's."""
    return _split_lines(spark, path).drop("block")


def _running(lines: DataFrame, **flags: Column) -> DataFrame:
    """lines with, for each flag, how many lines of the file have it so far: summed within each split, and over the splits before it."""
    marked = lines.withColumns({n: f.cast("long") for n, f in flags.items()})
    here = Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy("file", "block").agg(*[F.sum(n).alias(n) for n in flags])
    totals = totals.select("file", "block", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in flags])
    summed = marked.withColumns({n: F.sum(n).over(here) for n in flags}).join(F.broadcast(totals), ["file", "block"])
    return summed.withColumns({n: F.col(n) + F.col(f"_{n}") for n in flags}).drop(*[f"_{n}" for n in flags])


def read_columnar(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet data set; with a schema its columns and types are checked at once."""
    df = spark.read.parquet(path)
    if schema is not None:
        require(df, schema)
    return df


def require(df: DataFrame, schema: T.StructType) -> None:
    have = {f.name: f.dataType for f in df.schema}
    for f in schema:
        if f.name not in have:
            raise ValueError(f"column {f.name} is missing; there are {sorted(have)}")
        if have[f.name] != f.dataType:
            raise ValueError(f"column {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def read_json_lines_with_refs(spark: SparkSession, text_path: str, ref_path: str) -> DataFrame:
    """line, ref for each line that is not blank; as many references as lines are demanded, by position."""
    def kept(path: str, name: str) -> DataFrame:
        full = F.btrim("line") != ""
        return _running(_split_lines(spark, path), n=full).where(full).select((F.col("n") - 1).alias("n"), F.col("line").alias(name))

    both = kept(text_path, "line").join(kept(ref_path, "ref"), "n", "full")
    bad = F.raise_error(F.lit("text and references differ in length")).cast("string")
    return both.select("n", F.when(F.col("line").isNull() | F.col("ref").isNull(), bad).otherwise(F.col("line")).alias("line"), "ref")


#: Nested question answering files: data, paragraphs, questions, answers.
QA_SCHEMA = "version STRING, data ARRAY<STRUCT<title: STRING, paragraphs: ARRAY<STRUCT<context: STRING, qas: ARRAY<STRUCT<id: STRING, question: STRING, is_impossible: BOOLEAN, answers: ARRAY<STRUCT<text: STRING, answer_start: BIGINT>>>>>>>>"


def read_qa(spark: SparkSession, path: str, training: bool) -> DataFrame:
    """id, title, context, question, is_impossible, and the first answer (training) or all of them."""
    data = spark.read.json(path, schema=QA_SCHEMA, multiLine=True).select(F.explode("data").alias("d"))
    qas = data.select("d.title", F.explode("d.paragraphs").alias("p")).select("title", "p.context", F.explode("p.qas").alias("q"))
    impossible = F.coalesce("q.is_impossible", F.lit(False))
    base = [F.col("q.id").alias("id"), "title", "context", F.col("q.question").alias("question"), impossible.alias("is_impossible")]
    if training:
        first = F.when(~impossible, F.element_at("q.answers", 1))
        return qas.select(*base, first["text"].alias("answer_text"), first["answer_start"].alias("answer_start"))
    return qas.select(*base, F.when(impossible, F.array().cast("array<struct<text:string,answer_start:bigint>>")).otherwise(F.col("q.answers")).alias("answers"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not empty or white space only."""
    return spark.read.text(path).where(F.regexp_like("value", F.lit(r"\S")))


def read_blank_separated(spark: SparkSession, path: str) -> DataFrame:
    """file, doc, line_no, line: a blank line begins a new document."""
    blank = F.btrim("line") == ""
    return _running(_split_lines(spark, path), doc=blank).where(~blank).select("file", "line_no", "line", "doc")


def read_tagged_documents(spark: SparkSession, path: str) -> DataFrame:
    """file, doc, line_no, line: lines between <doc id= and </doc>, without the first, which is the title, and blank ones."""
    opened, closed = F.contains("line", F.lit("<doc id=")), F.contains("line", F.lit("</doc>"))
    marked = _running(_split_lines(spark, path), doc=opened, done=closed)
    body = marked.where((F.col("doc") > F.col("done")) & ~opened & (F.btrim("line") != ""))
    title = F.min("line_no").over(Window.partitionBy("file", "doc"))
    return body.withColumn("title", title).where("line_no > title").select("file", "line_no", "line", "doc")


def read_text_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """file, vec_id, embedding from lines of numbers between single spaces; another dimension is an error."""
    v = F.transform(F.split("line", " "), lambda x: x.cast("float"))
    bad = F.raise_error(F.concat(F.lit(f"a vector has not {dim} numbers but "), F.size(v).cast("string"))).cast("array<float>")
    return numbered_lines(spark, path).where(F.btrim("line") != "").select("file", F.col("line_no").cast("long").alias("vec_id"), F.when(F.size(v) == dim, v).otherwise(bad).alias("embedding"))


def read_npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """file, vec_id, embedding of .npy matrices: the row number is the id. One file is one task's."""
    import pandas as pd

    def rows(batches):
        import io

        import numpy as np

        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content):
                m = np.load(io.BytesIO(content), allow_pickle=False)
                for at in range(0, len(m), 1024):
                    part = m[at : at + 1024]
                    yield pd.DataFrame({"file": name, "vec_id": np.arange(at, at + len(part)), "embedding": list(part.astype("float32"))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, vec_id long, embedding array<float>")


def read_block_records(spark: SparkSession, path: str) -> DataFrame:
    """file, block_id, block: byte strings of a .npy array without pickled objects."""
    import pandas as pd

    def rows(batches):
        import io

        import numpy as np

        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content):
                m = np.load(io.BytesIO(content), allow_pickle=False)
                yield pd.DataFrame({"file": name, "block_id": np.arange(len(m)), "block": [bytes(x) for x in m]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, block_id long, block binary")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="qid BIGINT, pid BIGINT, rank INT, score DOUBLE")


#: File name endings and the readers for them.
FORMATS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parquet": lambda s, p: s.read.parquet(p),
    "orc": lambda s, p: s.read.orc(p),
    "json": read_json_array,
    "jsonl": lambda s, p: s.read.json(p),
    "csv": lambda s, p: s.read.csv(p, header=True),
    "tsv": lambda s, p: s.read.csv(p, header=True, sep="\t"),
    "txt": read_lines,
    "npy": read_npy_vectors,
}


def infer_format(path: str) -> str:
    """The format that a path's ending names; "pipe" for an empty path."""
    if not path:
        return "pipe"
    for name in FORMATS:
        if path.rstrip("/").endswith("." + name):
            return name
    raise ValueError(f"no format is known for {path}; there are {', '.join(FORMATS)}")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    return FORMATS[infer_format(path)](spark, path)


# ---------------------------------------------------------------- task files


def examples(rows: DataFrame, split: str, text_a: int, text_b: int | None, label: int | None, guid: int | None = None, guid_split: bool = True) -> DataFrame:
    """guid, text_a, text_b, label by column place (-1: the last); rows too short for one are left out."""
    most = max(x for x in (text_a, text_b if text_b is not None else 0, label if label is not None else 0, guid or 0))
    at = lambda k: F.lit(None).cast("string") if k is None else F.element_at("cols", k + 1 if k >= 0 else k)
    number = F.col("row_no").cast("string") if guid is None else at(guid)
    name = F.concat_ws("-", F.lit(split), number) if guid_split else number
    return rows.where(F.size("cols") > most).select(name.alias("guid"), at(text_a).alias("text_a"), at(text_b).alias("text_b"), at(label).alias("label"))


#: Columns (text_a, text_b, label, guid) of each task's training and test files; None: there is none. Fixed values.
TASKS: dict[str, dict[str, tuple[int, int | None, int | None, int | None]]] = {
    "mrpc": {"train": (3, 4, 0, None), "test": (3, 4, None, None)},
    "mnli": {"train": (8, 9, -1, 0), "test": (8, 9, None, 0)},
    "mnli-mm": {"train": (8, 9, -1, 0), "test": (8, 9, None, 0)},
    "cola": {"train": (3, None, 1, None), "test": (1, None, None, None)},
    "sst-2": {"train": (0, None, 1, None), "test": (1, None, None, None)},
    "sts-b": {"train": (7, 8, -1, 0), "test": (7, 8, None, 0)},
    "qqp": {"train": (3, 4, 5, 0), "test": (1, 2, None, 0)},
    "qnli": {"train": (1, 2, -1, 0), "test": (1, 2, None, 0)},
    "rte": {"train": (1, 2, -1, 0), "test": (1, 2, None, 0)},
    "wnli": {"train": (1, 2, -1, 0), "test": (1, 2, None, 0)},
}
#: Tasks whose training files have no header.
NO_HEADER = {("cola", "train"), ("cola", "dev")}


def read_task(spark: SparkSession, task: str, path: str, split: str) -> DataFrame:
    """Examples of a named task; an unknown name is a KeyError. Labels stay text but for the regression task."""
    text_a, text_b, label, guid = TASKS[task]["test" if split == "test" else "train"]
    rows = read_rows(spark, path, skip_header=(task, split) not in NO_HEADER)
    out = examples(rows, split, text_a, text_b, label, guid)
    return out.withColumn("label", F.col("label").cast("double")) if task == "sts-b" else out


def read_csv_examples(spark: SparkSession, path: str, split: str = "", label: int = 0, text: int = 1, guid: int | None = None, skip_first: bool = False) -> DataFrame:
    rows = read_rows(spark, path, skip_header=skip_first)
    return examples(rows, split, text, None, label, guid, guid_split=bool(split) and guid is None)


def read_xnli(spark: SparkSession, path: str, split: str, language: str = "en") -> DataFrame:
    """Cross-lingual pairs: training files hold one language, test files name it in their first column."""
    rows = read_rows(spark, path, skip_header=True)
    if split == "train":
        out = examples(rows, split, 0, 1, 2)
        return out.withColumn("label", F.when(F.col("label") == "contradictory", "contradiction").otherwise(F.col("label")))
    return examples(rows.where(F.element_at("cols", 1) == language), split, 6, 7, 1)


def label_map(labels: list[str]) -> Callable[[Column], Column]:
    """A label's place in the list; null stays null and an unknown one is an error."""
    names = F.array(*map(F.lit, labels))

    def place(label: Column) -> Column:
        at = F.array_position(names, label)
        return F.when(label.isNull(), F.lit(None).cast("int")).when(at > 0, (at - 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("unknown label "), label)).cast("int"))

    return place
