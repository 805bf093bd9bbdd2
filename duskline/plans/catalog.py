"""Registry of runnable queries, each with its SQL equivalent where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from duskline.plans.oracle_views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, select: str | None = None, steps: str = ""):
    """Register ``fn(spark, sf_dir)`` as ``name``; ``steps`` are further named subqueries."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if select is not None:
            ORACLES[name] = with_views(select, steps)
        return fn

    return register
