"""All queries over the shared tables, and the SQL that gives the same rows."""

from __future__ import annotations

from . import compare, file_queries, media_queries, pcm_queries, spectrum_queries

PARTS = (pcm_queries, spectrum_queries, compare, media_queries, file_queries)


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.oracle_sql().items()}
