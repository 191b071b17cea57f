"""Queries over the driver's tables, one or more per operator, with their oracles."""

from .registry import QUERIES, Query
from . import documents, history, sinks, sources, tables  # noqa: F401  (registers the queries)

__all__ = ["QUERIES", "Query"]
