"""Queries by name, with their SQL twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marquee.sources.bridge import one_query

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where SQL can say the same, the SQL that DuckDB checks it with."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")

        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with one_query():
                return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put
