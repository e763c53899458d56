"""All queries of the core, by name, and their SQL twins."""

from __future__ import annotations

from . import comparison, ingest, problems, ratings, reports, scope, selection, texts, topics

_MODULES = (problems, ratings, comparison, texts, topics, selection, ingest, reports, scope)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
