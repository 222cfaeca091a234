"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from . import aggregate_queries, judge_queries, library_queries, practice_queries, rewrite_queries, sequence_queries, signal_queries
from .registry import Query

_PARTS = (aggregate_queries.catalog, sequence_queries.catalog, library_queries.catalog, rewrite_queries.catalog, signal_queries.catalog, practice_queries.catalog, judge_queries.catalog)


def queries() -> dict[str, Query]:
    return {name: f for part in _PARTS for name, f in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.sql.items()}
