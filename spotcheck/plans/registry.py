"""The registry of queries, which the modules of plans fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spotcheck.sources.projection import SQL as PROJECTION

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, ctes: str = "", recursive: bool = True):
    """Register a function of (spark, sf_dir) under its name, with its SQL over the projected tables."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{PROJECTION}{', ' + ctes if ctes else ''}\n{sql}"
        return f

    return register
