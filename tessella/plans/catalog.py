"""All queries of the engine by name."""

from . import answers, corpus, engine, files, formats, functions, indexes, scoring, search, spans, streams, texts, vectors  # noqa: F401  they register their queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
