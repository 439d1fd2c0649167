"""Registry of the core queries and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: file a query under a name, with its oracle SQL if it has one."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["impact_radius"](spark, sf_dir)


def _load() -> None:
    from skein.plans import graph_queries, link_queries, search_queries, store_queries, text_queries  # noqa: F401  their import files the queries


_load()
