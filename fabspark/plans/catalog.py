"""Query catalog: inventory id -> (Spark callable, DuckDB oracle SQL).

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame built from the
driver's tables over their whole extent. Oracle SQL is optional: operators
that SQL cannot express (iterative fits, ML training) register none and are
covered by pytest invariants instead.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so their ``register`` calls run."""
    from . import (  # noqa: F401
        wafer_queries,
        yield_queries,
        profile_queries,
        evaluate_queries,
        sensor_queries,
        route_queries,
        ingest_queries,
        train_queries,
        stream_queries,
        inventory_queries,
    )
