"""Registration of queries and the SQL they are checked against."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    """Import every catalog module once, which fills the two tables above."""
    import cuestream.catalog as package

    for module in sorted(m.name for m in pkgutil.iter_modules(package.__path__)):
        importlib.import_module(f"cuestream.catalog.{module}")
