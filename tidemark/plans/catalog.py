"""Registry of named queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the equivalent SQL when there is one."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = _shipping(fn)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def _shipping(fn: Query) -> Query:
    """The query, with the package sent to the workers of its session first."""

    @wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf)

    return run


def with_tables(*ctes: str, body: str, recursive: bool = False) -> str:
    """A select over the given common table expressions."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body
