"""Queries of all modules, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("sessions", "legend", "progress", "selection", "browse", "colour", "stash", "grid", "palette", "image", "sync", "importer", "extract", "store", "insights", "exchange", "edges", "harmony", "contours", "files", "variations")
_found: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its oracle if SQL can express one."""

    def register(f: Query) -> Query:
        if f.__name__ in _found and _found[f.__name__][0].__module__ != f.__module__:
            raise ValueError(f"two queries are named {f.__name__}")
        _found[f.__name__] = (f, sql)
        return f

    return register


def _load() -> dict[str, tuple[Query, str | None]]:
    for name in MODULES:
        import_module(f"tessella.catalog.{name}")
    return _found


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _load().items() if sql}
