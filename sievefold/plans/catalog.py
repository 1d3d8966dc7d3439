"""Every query of the library by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, or another one, and its SQL for DuckDB."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if sql:
            ORACLE[key] = with_views(sql)
        return f

    return register


def load() -> None:
    """Imports the modules that register queries."""
    from . import aggregates, calendars, content, deletion_log, filters, joins, layouts, lifecycle, matching, projections, services, sinks  # noqa: F401
