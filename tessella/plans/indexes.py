"""Queries over stored indexes of vectors and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ann, retrieval
from ..operators.textindex import TextIndex
from .registry import SQL, query, table
from .search import _ASKED, _DOT, _L2, _asked, _rounded, _top

#: Every tenth of the true neighbours may be missed, no more.
_RECALL = "SELECT count(*) AS queries, 10 * count(*) AS hits, true AS found_nine_of_ten FROM embeddings WHERE vec_id % 20 = 0"


@query("ivf_all_cells", _top(_DOT, 5, where=_ASKED))
def ivf_all_cells(spark, d):
    """With all its cells an inverted file finds what the exact search finds."""
    v = table(spark, d, "embeddings")
    return _rounded(ann.VectorIndex.build(v, "IVF64,Flat").search(_asked(v), 5, reach=64))


@query("index_reloaded_exact", _top(_L2, 5, "ASC", _ASKED))
def index_reloaded_exact(spark, d):
    """The exact way out of an index read back from its files."""
    v = table(spark, d, "embeddings")
    index = ann.VectorIndex.load(spark, ann.VectorIndex.build(v, "HNSW16,Flat", "l2").path)
    return _rounded(index.search(_asked(v), 5, exact=True))


def _recall(spark, d, index, metric):
    v = table(spark, d, "embeddings")
    found = ann.VectorIndex.build(v, index, metric).search(_asked(v), 10)
    share = ann.recall(found, retrieval.knn(_asked(v), v, 10, metric))
    return share.select("queries", "hits", (F.col("share") >= 0.9).alias("found_nine_of_ten"))


@query("ivfpq_recall", _RECALL)
def ivfpq_recall(spark, d):
    return _recall(spark, d, "IVF64,PQ8", "ip")


@query("graph_recall", _RECALL)
def graph_recall(spark, d):
    return _recall(spark, d, "HNSW16,Flat", "l2")


@query("text_index_top5", SQL["bm25_top5"])
def text_index_top5(spark, d):
    """The hits of the full scan, from the posting blocks of the queries' words."""
    return TextIndex.build(table(spark, d, "documents")).search(table(spark, d, "benchmark"), 5)


@query("stemmed_index_top5")
def stemmed_index_top5(spark, d):
    return TextIndex.build(table(spark, d, "documents"), stemmed=True).search(table(spark, d, "benchmark"), 5)
