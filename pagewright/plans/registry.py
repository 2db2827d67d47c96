"""The library's queries and their DuckDB SQL."""

from __future__ import annotations

from pagewright.plans import audit_queries, layout_queries, page_queries, piece_queries, stream_queries, text_queries

MODULES: tuple = (text_queries, layout_queries, page_queries, piece_queries, audit_queries, stream_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
