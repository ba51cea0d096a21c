"""Registry of the named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from selectra.plans.bindings import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, statement: str | None = None):
    """Register a query; without a statement only its rows are checked."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if statement is not None:
            SQL[name] = statement
        return fn

    return register


def load() -> None:
    from selectra.plans import (  # noqa: F401
        queries_relational, queries_selection, queries_graphs, queries_statistics, queries_learning, queries_ingest)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    bind = lambda fn: lambda spark, folder: fn(Tables(spark, folder))
    return {name: bind(fn) for name, fn in QUERIES.items()}


def all_sql() -> dict[str, str]:
    load()
    return dict(SQL)
