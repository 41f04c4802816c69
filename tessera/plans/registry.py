"""All registered queries; each module of this package adds its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Queries on built-in or fixed rows, which read no given table: for tests, not registered.
EXAMPLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def example(name: str, sql: str | None = None):
    """Keep ``fn(spark, sf_dir)`` under ``name`` without registering it."""

    def add(fn):
        EXAMPLES[name] = fn
        return fn

    return add


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its SQL form when there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
