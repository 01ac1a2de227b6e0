"""All queries of the engine by operator id, with their SQL.

A module of ``plans`` registers a query with :func:`query`; the id is that of the operator inventory.
"""

from __future__ import annotations

import functools
import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import workers_can_import

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that gives the same rows where there is any."""

    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    from . import plans

    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"{plans.__name__}.{module.name}")


def _ready(f: Query) -> Query:
    """The query with workers that can import the package."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        workers_can_import(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    _load()
    return {name: _ready(f) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive retrieval: scout, decide by spread, re-rank."""
    return queries()["RUN-2"](spark, sf_dir)
