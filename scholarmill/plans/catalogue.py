"""The named queries of the core library and their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_PARTS = ("search",)


def _parts():
    return [importlib.import_module(f"scholarmill.plans.{p}") for p in _PARTS]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All core queries."""
    return {k: f for p in _parts() for k, f in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the core queries that have one."""
    return {k: s for p in _parts() for k, s in p.ORACLE.items()}
