"""Queries over every reader and sink: rows of the tables are written in the reader's format, read back and held against the tables."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mapping import run_files
from ..operators.storage import new_path
from ..sources import readers as R
from ..sources import sinks as W
from .registry import query, table


def write_lines(df: DataFrame, path: str, order: str = "n", line: str = "line") -> None:
    """One text file whose lines are in order: for the small files that such readers take whole."""
    df.repartition(1).sortWithinPartitions(order).select(F.col(line).alias("value")).write.text(path)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file of the shared folder from bytes on the driver."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def with_header(df: DataFrame, line: str) -> DataFrame:
    return df.unionByName(df.sparkSession.createDataFrame([(-1, line)], "n long, line string"))


# ---------------------------------------------------------------- delimited text


@query("read_tsv_table", "SELECT n_nationkey AS key, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def read_tsv_table(spark, d):
    path = new_path(spark, "tsv")
    table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.csv(path, sep="\t", header=True)
    return R.read_tsv(spark, path, "key INT, name STRING, region BIGINT", header=True)


@query("read_tsv_quotes", "SELECT 'n\"' || n_name || '\"' AS name, n_nationkey AS key FROM nation")
def read_tsv_quotes(spark, d):
    """Quotes are letters like others, and the mark before the first line is none."""
    path = new_path(spark, "tsv")
    mark = F.when(F.col("n_nationkey") == 0, "\ufeff").otherwise("")
    write_lines(table(spark, d, "nation").select("n_nationkey", F.concat(mark, F.lit('n"'), "n_name", F.lit('"\t'), F.col("n_nationkey").cast("string")).alias("line")), path, "n_nationkey")
    return R.read_tsv(spark, path, "name STRING, key INT")


@query("read_rows_numbered", "SELECT n_nationkey + 1 AS row_no, [n_name, '', CAST(n_regionkey AS VARCHAR)] AS cols FROM nation")
def read_rows_numbered(spark, d):
    path = new_path(spark, "rows")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.concat_ws("\t", "n_name", F.lit(""), "n_regionkey").alias("line"))
    write_lines(with_header(rows, "name\tnone\tregion"), path)
    return R.read_rows(spark, path, skip_header=True).select("row_no", "cols")


# ---------------------------------------------------------------- JSON and documents


@query("json_array_round_trip", "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM nation")
def json_array_round_trip(spark, d):
    """A file for each region, with one array of its nations."""
    path = new_path(spark, "json")
    rows = F.to_json(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))))
    table(spark, d, "nation").groupBy("n_regionkey").agg(rows.alias("value")).write.partitionBy("n_regionkey").text(path)
    return R.read_json_array(spark, f"{path}/*", "key BIGINT, name STRING")


@query("json_array_pretty", "SELECT n_nationkey, n_name FROM nation")
def json_array_pretty(spark, d):
    path = new_path(spark, "json")
    W.save_json_array(table(spark, d, "nation").select("n_nationkey", "n_name"), path)
    return R.read_json_array(spark, path, "n_nationkey INT, n_name STRING")


@query("records_table", "SELECT 'plain' AS name, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'ünï', NULL")
def records_table(spark, d):
    return W.from_records(spark, [{"name": "plain", "n": 1}, {"name": "ünï", "n": None}], "name STRING, n BIGINT")


@query("json_fields", "SELECT event_id, props ->> '$.k' AS k, len(json_keys(props)) AS n FROM events")
def json_fields(spark, d):
    """Fields of a JSON column by path and by schema."""
    from ..functions.text import json_field, json_keys

    return table(spark, d, "events").select("event_id", json_field(F.col("props"), "k").alias("k"), F.size(json_keys(F.col("props"))).cast("long").alias("n"))


@query("tagged_documents", "SELECT n_nationkey + 1 AS doc, line FROM (SELECT n_nationkey, unnest(['first of ' || n_name, 'last']) AS line FROM nation)")
def tagged_documents(spark, d):
    path = new_path(spark, "tagged")
    lines = F.array(F.concat(F.lit('<doc id="'), "n_nationkey", F.lit('">')), F.concat(F.lit("Title "), "n_name"), F.lit(""), F.concat(F.lit("first of "), "n_name"), F.lit("  "), F.lit("last"), F.lit("</doc>"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.posexplode(lines).alias("k", "line"))
    write_lines(n.select((F.col("n_nationkey") * 10 + F.col("k")).alias("n"), "line"), path)
    return R.read_tagged_documents(spark, path).select(F.col("doc").cast("int").alias("doc"), "line")


# ---------------------------------------------------------------- arrays


def array_file(values: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, values, allow_pickle=False)
    return out.getvalue()


@query("npy_vectors", "SELECT CAST(f.file AS INT) AS file, CAST(r AS BIGINT) AS vec_id, list_transform(range(0, 4), lambda j: CAST(f.file * 1000 + r + j / 4.0 AS FLOAT)) AS embedding FROM (SELECT unnest([0, 1]) AS file) f, range(0, 1500) t(r)")
def npy_vectors(spark, d):
    folder = new_path(spark, "npy")
    for k in range(2):
        write_bytes(spark, f"{folder}/{k}.npy", array_file(k * 1000 + np.arange(1500)[:, None] + np.arange(4) / 4))
    return R.read_any(spark, f"{folder}/*.npy").select(F.regexp_extract("file", r"(\d+)\.npy$", 1).cast("int").alias("file"), "vec_id", "embedding")


@query("block_records", "SELECT CAST(r AS BIGINT) AS block_id, 'block ' || r AS block FROM range(0, 300) t(r)")
def block_records(spark, d):
    path = new_path(spark, "blocks") + "/a.npy"
    write_bytes(spark, path, array_file(np.array([f"block {k}".encode() for k in range(300)])))
    return R.read_block_records(spark, path).select("block_id", F.col("block").cast("string").alias("block"))


# ---------------------------------------------------------------- formats and caches


@query("inferred_formats", "SELECT * FROM (VALUES ('', 'pipe'), ('a/b.parquet', 'parquet'), ('x.jsonl', 'jsonl'), ('x.json', 'json'), ('y.csv', 'csv'), ('z.tsv/', 'tsv'), ('t.txt', 'txt'), ('v.npy', 'npy'), ('o.orc', 'orc')) t(path, format)")
def inferred_formats(spark, d):
    paths = ["", "a/b.parquet", "x.jsonl", "x.json", "y.csv", "z.tsv/", "t.txt", "v.npy", "o.orc"]
    return spark.createDataFrame([(p, R.infer_format(p)) for p in paths], "path STRING, format STRING")


@query("files_through_a_function", "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(length(p_name) AS BIGINT) AS n FROM part")
def files_through_a_function(spark, d):
    source, target = new_path(spark, "in") + ".csv", new_path(spark, "out")
    table(spark, d, "part").select("p_partkey", "p_name").write.csv(source, header=True)
    run_files(spark, source, target, _lengths, "p_partkey BIGINT, n BIGINT")
    return R.read_columnar(spark, target)


def _lengths(pdf):
    return pdf.assign(p_partkey=pdf.p_partkey.astype("int64"), n=pdf.p_name.str.len().astype("int64"))[["p_partkey", "n"]]


@query("cache_is_built_once", "SELECT n_name, 1 AS builds FROM nation")
def cache_is_built_once(spark, d):
    path, built = new_path(spark, "cache"), []

    def build():
        built.append(1)
        return table(spark, d, "nation").select("n_name")

    W.cached_table(spark, path, build)
    return W.cached_table(spark, path, build).withColumn("builds", F.lit(len(built)))


# ---------------------------------------------------------------- task files


def cell(kind: str) -> Column:
    """What stands in a cell of a task file, made of a benchmark item; the same in _CELL as SQL."""
    clean = F.regexp_replace("text", r"\s+", " ")
    return {"a": clean, "b": F.concat(F.lit("b "), F.reverse(F.col("item_id").cast("string"))), "label": F.pmod("item_id", F.lit(3)).cast("string"), "guid": F.concat(F.lit("g"), "item_id")}[kind]


_CELL = {"a": r"regexp_replace(text, '\s+', ' ', 'g')", "b": "'b ' || reverse(CAST(item_id AS VARCHAR))", "label": "CAST(item_id % 3 AS VARCHAR)", "guid": "'g' || item_id"}


def task_file(spark: SparkSession, d: str, places: dict[int, str], width: int, header: bool) -> str:
    """A task file of all benchmark items: cells by place, `x` elsewhere."""
    path = new_path(spark, "task")
    cells = [cell(places[k]) if k in places else F.lit("x") for k in range(width)]
    rows = table(spark, d, "benchmark").where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("n"), F.concat_ws("\t", *cells).alias("line"))
    write_lines(with_header(rows, "\t".join(f"h{k}" for k in range(width))) if header else rows, path)
    return path


def layout(columns: tuple[int, int | None, int | None, int | None]) -> tuple[dict[int, str], int]:
    """Which cell stands at which place of a task's file, and how many there are: one more than any that is read from the left."""
    width = max(x for x in columns if x is not None) + 2
    return {(x if x >= 0 else width + x): kind for x, kind in zip(columns, ("a", "b", "label", "guid")) if x is not None}, width


def task_query(task: str) -> None:
    def sql(split: str) -> str:
        columns = R.TASKS[task][split]
        first = 0 if (task, split) in R.NO_HEADER else 1
        guid = _CELL["guid"] if columns[3] is not None else f"row_number() OVER (ORDER BY item_id) - 1 + {first}"
        a, b, label = (_CELL[k] if c is not None else "NULL" for k, c in zip(("a", "b", "label"), columns))
        label = f"CAST({label} AS DOUBLE)" if task == "sts-b" else f"CAST({label} AS VARCHAR)"
        return f"SELECT '{split}-' || {guid} AS guid, {a} AS text_a, CAST({b} AS VARCHAR) AS text_b, {label} AS label FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL"

    @query("read_task_" + task.replace("-", "_"), sql("train") + " UNION ALL " + sql("test"))
    def run(spark, d):
        parts = []
        for split in ("train", "test"):
            places, width = layout(R.TASKS[task][split])
            parts.append(R.read_task(spark, task, task_file(spark, d, places, width, (task, split) not in R.NO_HEADER), split))
        return parts[0].unionByName(parts[1]).select("guid", "text_a", "text_b", "label")


for _task in R.TASKS:
    task_query(_task)


@query("read_csv_examples", f"SELECT 'g' || item_id AS guid, {_CELL['a']} AS text_a, CAST(NULL AS VARCHAR) AS text_b, {_CELL['label']} AS label FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL")
def read_csv_examples(spark, d):
    return R.read_csv_examples(spark, task_file(spark, d, {0: "label", 1: "a", 2: "guid"}, 3, True), label=0, text=1, guid=2, skip_first=True)


@query("read_xnli_train", "SELECT 'train-' || (n_nationkey + 1) AS guid, n_name AS text_a, 'b' AS text_b, CASE WHEN n_regionkey = 0 THEN 'contradiction' ELSE 'neutral' END AS label FROM nation")
def read_xnli_train(spark, d):
    path = new_path(spark, "xnli")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.concat_ws("\t", "n_name", F.lit("b"), F.when(F.col("n_regionkey") == 0, "contradictory").otherwise("neutral")).alias("line"))
    write_lines(with_header(rows, "premise\thypo\tlabel"), path)
    return R.read_xnli(spark, path, "train")


@query("read_xnli_test", "SELECT 'test-' || (n_nationkey + 1) AS guid, n_name AS text_a, 'b' AS text_b, 'neutral' AS label FROM nation WHERE n_regionkey = 1")
def read_xnli_test(spark, d):
    path = new_path(spark, "xnli")
    language = F.when(F.col("n_regionkey") == 1, "en").otherwise("de")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.concat_ws("\t", language, F.lit("neutral"), *[F.lit("x")] * 4, "n_name", F.lit("b"), F.lit("x")).alias("line"))
    write_lines(with_header(rows, "\t".join("h" * 9)), path)
    return R.read_xnli(spark, path, "test")
