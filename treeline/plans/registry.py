"""Registry of the driver-facing queries.

``REGISTRY[key]`` is a callable ``(spark, sf_dir) -> DataFrame``;
``ORACLE[key]`` is the DuckDB SQL computing the same rows with the same
column names (absent for operators SQL cannot express).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module (each registers itself)."""
    from treeline.plans import (  # noqa: F401
        queries,
        scan_queries,
        browse_queries,
        grep_queries,
        history_queries,
        catalog_queries,
        docs_queries,
        vector_queries,
        streaming_queries,
        store_queries,
    )
