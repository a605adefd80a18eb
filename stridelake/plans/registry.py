"""Registered queries and their SQL. A plan module adds to both with query()."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stridelake.sources.adapters import PRELUDE, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The same as functions of domain tables, wherever these come from.
OVER_TABLES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "a15_section_records"


def query(name: str, sql: str | None = None):
    """Register a function of Tables; sql follows the prelude's CTEs (", x as (...)" may come first)."""

    def add(f: Callable[[Tables], DataFrame]):
        OVER_TABLES[name] = f
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = PRELUDE + sql
        return f

    return add


for _m in ("fitness", "sections", "routes", "strength", "spatial", "patterns", "smoothing", "insights", "heatmap", "tables", "detection", "upkeep", "keeping"):
    importlib.import_module(f"stridelake.plans.{_m}")
