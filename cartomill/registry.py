"""All queries of the library, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None, f: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = f
    if sql:
        ORACLE_SQL[name] = sql


def graph_query(name: str, sql: str | None, f: Callable) -> None:
    """A query over the derived graph; its SQL may use g_files, g_symbols and g_edges."""
    from .sources.graph_tables import WITH, derived

    sep = "," if sql and sql.lstrip().startswith("WITH ") else ""
    query(name, sql and WITH + (sep + sql.lstrip()[4:] if sep else sql), lambda spark, sf_dir: f(derived(spark, sf_dir)))


def load() -> None:
    from .plans import graph_queries, language_queries, other_queries, relational_queries, source_queries  # noqa: F401
