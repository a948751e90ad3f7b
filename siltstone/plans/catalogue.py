"""Every registered query with its SQL twin."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.session import configure

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under ``name``; ``sql`` is its DuckDB equivalent, if there is one."""

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: query(configure(spark), sf_dir)
        if sql is not None:
            _SQL[name] = sql
        return query

    return add


def _loaded() -> None:
    import siltstone.plans

    for found in pkgutil.iter_modules(siltstone.plans.__path__):
        if found.name.startswith("q_"):
            importlib.import_module(f"siltstone.plans.{found.name}")


def queries() -> dict[str, Query]:
    _loaded()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(_SQL)
