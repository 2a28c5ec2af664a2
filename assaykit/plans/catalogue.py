"""The query catalogue: one entry per operator, with its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("scoring", "comparing", "flows", "authored", "judging", "reading", "personal")


def _all(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f"assaykit.plans.{m}"), name).items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
