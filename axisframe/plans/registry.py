"""Registry of queries over the given tables and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from axisframe.plans.inputs import sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: str | None = None, body: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``body`` is its SQL over the named inputs, where SQL can say it."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if body is not None:
            ORACLES[name] = sql(needs or "", body)
        return fn
    return register
