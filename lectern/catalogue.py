"""Every query of the engine by name, with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of ``lectern.plans`` that hold QUERIES and ORACLES.
MODULES: tuple[str, ...] = ("chunks", "retrieval", "answers", "evaluation", "spans", "corpus", "inventory", "monitoring", "serving", "checks")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in MODULES:
        found |= import_module(f"lectern.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"lectern.plans.{name}").ORACLES
    return found
