"""Registry of queries over the driver's tables and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .hosts import Hosts

QUERIES: dict[str, Callable[[Hosts], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(hosts) -> DataFrame`` and, where one exists, its SQL."""
    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def seconds(df: DataFrame, *columns: str) -> DataFrame:
    """Milliseconds to seconds, rounded for the comparison."""
    return df.withColumns({c: F.round(F.col(c) / 1000, 6) for c in columns})
