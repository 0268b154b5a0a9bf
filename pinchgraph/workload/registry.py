"""Registry of named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pinchgraph.session import configure
from pinchgraph.workload.sqlviews import with_views
from pinchgraph.workload.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable:
    """Register `fn(views) -> DataFrame` under `name`; `sql` runs over the SQL `views` it names."""
    def add(fn: Callable[[Views], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(configure(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, views.split())
        return fn

    return add
