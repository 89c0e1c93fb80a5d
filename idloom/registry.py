"""Queries by name and their SQL for the comparison with DuckDB."""

from __future__ import annotations

from idloom.plans import alignment_queries, domain_queries, linkage_queries, machine_queries, operations_queries, photo_queries, quality_queries, record_queries

_ALL = quality_queries.QUERIES | linkage_queries.QUERIES | operations_queries.QUERIES | domain_queries.QUERIES | record_queries.QUERIES | photo_queries.QUERIES | alignment_queries.QUERIES | machine_queries.QUERIES


def queries() -> dict:
    return {name: fn for name, (fn, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
