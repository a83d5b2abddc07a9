"""The corpus pipeline: quality, near duplicates, decontamination, mixture, token output.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm._common import stored
from tessella.llm.decontaminate import clean_documents
from tessella.llm.mixing import mixed_documents
from tessella.llm.parity_join import keep_one
from tessella.llm.quality import accepted_documents
from tessella.llm.queries import table, tokenizer_path
from tessella.llm.token_store import new_store_path, token_digest, write_tokens


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return accepted_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group that the n-gram Jaccard join links."""
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mixture draws them: one row for each epoch, the last of a leaf cut to its token-prefix."""
    return mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of the mixture: doc_id, start, n_tokens and ids_crc32 as read back from it."""
    return token_digest(write_tokens(docs, new_store_path(spark), tokenizer_path()))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mixture),
    ("token output", token_output),
]
#: The classifier and the tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
