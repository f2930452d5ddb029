"""Names queries and pairs them with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.sources.derived import Library, library, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of a Library under ``name``; ``sql`` may name the derived views."""

    def keep(f: Callable[[Library], DataFrame]) -> Callable[[Library], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(library(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return f

    return keep
