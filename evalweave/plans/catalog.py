"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
NUDGE = 1e-12


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and its SQL if there is any.

    Doubles are rounded to nine places on both sides; the nudge (as in
    ``stats.rounded``) keeps halves from going one way here and the other there.
    """

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql.replace(", 9)", f" + {NUDGE!r}, 9)")
        return f

    return add


def _load() -> None:
    """Imports the modules that register queries."""
    from . import records, stats, texts  # noqa: F401


_load()
