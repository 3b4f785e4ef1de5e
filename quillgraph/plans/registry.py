"""Registered queries over the driver tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: adds a query, and its SQL, under a name."""

    def add(fn):
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return add


def _load() -> None:
    """Imports the modules that register."""
    from . import activity, boards, builds, graphs, identity, lookups, recommendation  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
