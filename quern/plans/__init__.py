"""Queries over the engine's operators, and the SQL they must equal."""

from quern.plans import document_queries, fulltext_queries, more_queries, search_queries, snapshot_queries, store_queries

_MODULES = [search_queries, snapshot_queries, store_queries, more_queries, document_queries, fulltext_queries]


def queries() -> dict:
    """Every registered query of the core."""
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those that SQL can express."""
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
