"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed lookup table (tens of rows) for broadcast joins."""
    return spark.createDataFrame(rows, schema)


def glob_to_regex(pattern: str) -> str:
    """Translate a shell glob (``*``, ``?``, ``[...]``) to an anchored regex body."""
    import fnmatch

    rx = fnmatch.translate(pattern)  # '(?s:...)\\Z'
    if rx.startswith("(?s:") and rx.endswith(")\\Z"):
        rx = rx[4:-3]
    return rx


