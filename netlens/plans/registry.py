"""Registered queries: a name, a function of (spark, sf_dir), and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a function; views are the WITH parts that its SQL needs."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            with_parts = ", ".join(dict.fromkeys(views))
            ORACLE_SQL[name] = f"WITH RECURSIVE {with_parts} {sql}" if views else sql
        return fn

    return register
