"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (
    "sources",
    "cleaning",
    "chunking",
    "catalog",
    "planning",
    "retrieval",
    "context",
    "conversation",
    "evaluation",
    "streaming",
)
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL where SQL can express it."""

    def add(run: Query) -> Query:
        _QUERIES[run.__name__] = run
        if sql:
            _SQL[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    """Name to query, for every operator of the library."""
    for m in MODULES:
        importlib.import_module(f"paperloom.plans.{m}")
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name to the SQL that gives the same rows."""
    queries()
    return dict(_SQL)
