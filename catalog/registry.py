"""Collects the registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.derived import tidy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, fn: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise KeyError(name)
    QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = sql
