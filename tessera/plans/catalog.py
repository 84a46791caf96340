"""All queries of the engine's own operators, with their SQL oracles."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in _queries:
            raise ValueError(f"two queries are named {key}")
        _queries[key] = f
        if sql:
            _oracles[key] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    _collect()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _collect()
    return dict(_oracles)


def _collect() -> None:
    """Import the modules whose queries register themselves."""
    for name in ("relational", "aggregates", "windows", "functions", "search", "domain", "more", "reports", "feeds", "streams", "intelligence", "learning", "government"):
        if importlib.util.find_spec(f"tessera.plans.{name}"):
            importlib.import_module(f"tessera.plans.{name}")
