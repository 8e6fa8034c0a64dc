"""The registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["nested", "text", "advantages", "metrics", "arrays", "batch", "flows", "grading", "dataset"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out |= import_module(f"millrace.catalog.{m}").QUERIES
    return out


def sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"millrace.catalog.{m}").SQL
    return out
