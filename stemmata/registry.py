"""All queries of the core library, by name, and their SQL."""

from __future__ import annotations


def _modules() -> list:
    from .plans import compare_queries, export_queries, index_queries, reader_queries

    return [compare_queries, index_queries, export_queries, reader_queries]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
