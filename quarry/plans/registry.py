"""Collects the queries of the modules in this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("text_queries", "metadata_queries", "search_queries", "page_queries", "record_queries", "upkeep_queries", "source_queries")


def _modules() -> list:
    from importlib import import_module

    return [import_module(f"quarry.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> callable of (spark, folder of tables)."""
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name -> the same result in SQL."""
    return {k: s for m in _modules() for k, s in m.ORACLE.items()}
