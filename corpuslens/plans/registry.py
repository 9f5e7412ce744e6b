"""All core queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ["instants", "catalog", "ingest", "texts", "vectors", "scanning", "review", "events"]


def core_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in MODULES:
        out |= import_module(f"corpuslens.plans.{m}").QUERIES
    return out


def core_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"corpuslens.plans.{m}").SQL
    return out
