"""Named queries and the DuckDB statement that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakestate.plans.oracle_tables import with_views
from lakestate.sources.adapters import Lake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register ``fn(lake) -> DataFrame`` under ``name`` with its check."""

    def register(fn: Callable[[Lake], DataFrame]):
        def run(spark: SparkSession, root: str) -> DataFrame:
            return fn(Lake(spark, root))

        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, extra)
        return fn

    return register
