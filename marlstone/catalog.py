"""Every query of the engine, gathered from the plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("serving", "scalars", "integrate", "discover", "crawling", "walking", "steps", "audit", "stream", "upkeep", "connectors")


def _modules():
    return [importlib.import_module(f"marlstone.plans.{m}") for m in MODULES]


def queries() -> dict[str, Query]:
    return {k: q for m in _modules() for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLES.items()}
