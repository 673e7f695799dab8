"""Registry of named queries: ``name -> (spark builder, DuckDB oracle SQL)``.

Every builder takes ``(spark, sf_dir)`` and reads the given tables (or the
request frame Spark derives from them), so its work grows with the data.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}

_MODULES = ("rankings", "analytics", "ingest", "vectors", "labels", "products", "points",
            "reports", "streams", "incremental")


def register(name: str, sql: str | None = None):
    """Decorator: register a builder and, when SQL can express it, its oracle."""
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"civiclens.plans.{m}")


def queries() -> dict[str, Builder]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
