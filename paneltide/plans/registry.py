"""Queries by name, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Registers a function under its name; ``ctes`` are put before ``sql``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = (f"WITH {', '.join(c.strip() for c in ctes)}\n" if ctes else "") + sql.strip()
        return f

    return add


def rounded(c: Column | str, places: int = 8) -> Column:
    """Rounded for comparison across engines (sums run in another order there), without negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, places) + F.lit(0.0)
