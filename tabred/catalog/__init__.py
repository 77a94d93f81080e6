"""Registry of runnable queries: name, Spark function of (session, folder), and DuckDB text if there is one."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, fn: QueryFn, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = fn
    if sql is not None:
        ORACLES[name] = sql


def load_all() -> tuple[dict[str, QueryFn], dict[str, str]]:
    """Import every catalog module once and return (queries, oracles)."""
    import importlib
    import pkgutil
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return QUERIES, ORACLES
