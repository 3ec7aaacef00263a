"""Query registry: key -> Spark callable, with the DuckDB oracle text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hindcast.plans.oracle import with_ctes

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, *ctes: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `ctes` names the shared oracle relations its SQL uses."""

    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_ctes(ctes, sql)
        return fn

    return register
