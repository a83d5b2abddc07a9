"""Operators that SQL can call: table functions, and column functions by name."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import text as text_functions


class Chunks:
    """tessella_chunks(TABLE(rows), text column, size, stride): every row with chunk, n_words and chunk_text, for runs of `size` words that begin
    `stride` words apart, up to the one that reaches the end. A text without words has no chunk."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, size: AnalyzeArgument, stride: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not all(x.isConstantExpression for x in (column, size, stride)):
            raise ValueError("tessella_chunks takes a table, the name of its text column, a size and a stride")
        names = [f.name for f in rows.dataType]
        if column.value not in names:
            raise ValueError(f"column {column.value} is missing; there are {names}")
        if size.value < 1 or stride.value < 1:
            raise ValueError("size and stride are 1 or more")
        kept = [f for f in rows.dataType if f.name != column.value]
        clash = {"chunk", "n_words", "chunk_text"} & {f.name for f in kept}
        if clash:
            raise ValueError(f"columns {sorted(clash)} are the function's own")
        return AnalyzeResult(T.StructType([*kept, T.StructField("chunk", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("chunk_text", T.StringType())]))

    def eval(self, row, column: str, size: int, stride: int) -> Iterator[tuple]:
        words = (row[column] or "").split()
        kept = [v for k, v in row.asDict().items() if k != column]
        for n, at in enumerate(range(0, len(words), stride)):
            part = words[at : at + size]
            yield (*kept, n, len(part), " ".join(part))
            if at + size >= len(words):
                break


class Runs:
    """tessella_runs(TABLE(rows) PARTITION BY key ORDER BY place, key column, item column): the key, item, place and length of every run of equal
    items. It holds one run at a time, however long a partition is."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        types = {f.name: f.dataType for f in rows.dataType} if rows.isTable else {}
        if key.value not in types or column.value not in types:
            raise ValueError("tessella_runs takes a table and the names of its columns of keys and items")
        fields = [T.StructField("run_key", types[key.value]), T.StructField("item", types[column.value]), T.StructField("place", T.LongType()), T.StructField("length", T.LongType())]
        return AnalyzeResult(T.StructType(fields))

    def __init__(self):
        self.run, self.start, self.length, self.seen = None, 0, 0, 0

    def eval(self, row, key: str, column: str) -> Iterator[tuple]:
        run = row[key], row[column]
        if self.length and run != self.run:
            yield (*self.run, self.start, self.length)
            self.length = 0
        if not self.length:
            self.run, self.start = run, self.seen
        self.length += 1
        self.seen += 1

    def terminate(self) -> Iterator[tuple]:
        if self.length:
            yield (*self.run, self.start, self.length)


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_TOKENS = "filter(split({}, r'(?U)\\s+'), w -> w <> '')"
_PLAIN = f"translate(lower(coalesce(t, '')), {_literal(text_functions.PUNCTUATION)}, '')"
#: SQL functions of one text t: type and body. Spark inlines and optimizes them; no Python runs for them.
TEXT_FUNCTIONS = {
    "tessella_collapse_whitespace": ("STRING", r"regexp_replace(t, r'\s+', ' ')"),
    "tessella_normalize_answer": ("STRING", f"array_join(filter({_TOKENS.format(_PLAIN)}, w -> w NOT IN ({', '.join(map(_literal, text_functions.ARTICLES))})), ' ')"),
    "tessella_word_count": ("INT", f"size({_TOKENS.format("coalesce(t, '')")})"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions in a session, and returns their names."""
    for name, cls in (("tessella_chunks", Chunks), ("tessella_runs", Runs)):
        spark.udtf.register(name, F.udtf(cls))
    for name, (kind, body) in TEXT_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    return ["tessella_chunks", "tessella_runs", *TEXT_FUNCTIONS]
