"""Registration of queries: a name, the function that builds the DataFrame and, where there is one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from landloom.plans.views import relation, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *inputs: str) -> Callable:
    """Registers a function of (spark, *inputs as DataFrames) under its own name."""

    def register(f: Callable) -> Callable:
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, *[relation(spark, sf_dir, x) for x in inputs])

        build.__doc__ = f.__doc__
        QUERIES[f.__name__] = build
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return register
