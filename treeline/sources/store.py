"""Catalog tables (S10, M9): plain tables of Spark's own catalog.

A catalog is a Spark database; its tables are Parquet tables that Spark
creates, reads, appends to and drops.  Tables that are computed from their own
old rows are written beside them first and then take their place together:
once all are written, a table ``publish__ready`` names them.  A job that dies
before that has changed nothing; one that dies later is finished by the next
:class:`CatalogStore` of the same database.

Tables with a column ``bucket`` are partitioned by it.  A publish may name the
buckets that it touches: only these are written and replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.session import scratch_path


#: Table that names the tables of a publish once all of them are written.
READY = "publish__ready"


class CatalogStore:
    """The tables of one database.  ``location`` is the folder for its files
    (a shared one; below spark.checkpoint.dir by default)."""

    def __init__(self, spark: SparkSession, database: str = "treeline", location: str | None = None):
        self.spark, self.database = spark, database
        self.location = location or scratch_path(spark, "catalog")
        self._create()

    def _create(self) -> None:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database} LOCATION '{self.location}'")
        self.recover()

    def _all(self) -> set[str]:
        return {t.name for t in self.spark.catalog.listTables(self.database)}

    def tables(self) -> list[str]:
        return sorted(n for n in self._all() if not n.endswith(("__next", "__ready")))

    def recover(self) -> None:
        """Finishes a publish that was cut short after all its tables were
        written, and forgets the tables of one that was not."""
        if READY in self._all():
            self._swap([(r.name, r.buckets) for r in self.read(READY).collect()])
        for n in self._all():
            if n.endswith("__next"):
                self.drop(n)

    def read(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows; no stored row is touched."""
        rows.write.mode("append").format("parquet").saveAsTable(f"{self.database}.{name}")

    def _swap(self, steps: list[tuple[str, list[int] | None]]) -> None:
        """Puts the written tables, or buckets, in place of the old.  May be repeated after any step."""
        for name, buckets in steps:
            following = f"{name}__next"
            if following not in self._all():
                continue
            rows = self.read(following)
            if "bucket" not in rows.columns:
                self.drop(name)
                self.spark.sql(f"ALTER TABLE {self.database}.{following} RENAME TO {self.database}.{name}")
                continue
            if name not in self._all():
                rows.limit(0).write.format("parquet").partitionBy("bucket").saveAsTable(f"{self.database}.{name}")
            if buckets is not None:
                filled = {r.bucket for r in rows.select("bucket").distinct().collect()}
                for b in set(buckets) - filled:
                    self.spark.sql(f"ALTER TABLE {self.database}.{name} DROP IF EXISTS PARTITION (bucket={b})")
            if buckets is None or filled:
                self._overwrite(name, rows, "static" if buckets is None else "dynamic")
            self.drop(following)
        self.drop(READY)

    def _overwrite(self, name: str, rows: DataFrame, mode: str) -> None:
        """All rows of a table (static), or those of the buckets that ``rows`` holds (dynamic)."""
        setting = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, mode)
        try:
            rows.select(*self.read(name).columns).write.mode("overwrite").insertInto(f"{self.database}.{name}")
        finally:
            self.spark.conf.set(setting, before)

    def publish(self, tables: dict[str, DataFrame], touched: list[int] | None = None) -> None:
        """Creates or replaces tables, which may be computed from the ones
        they replace.  All of them or, after a crash, none.

        ``touched``: the buckets that the rows belong to; where a table with
        buckets exists, its other buckets stay as they are."""
        steps, there = [], self._all()
        for name, df in tables.items():
            self.drop(f"{name}__next")
            partial = touched is not None and name in there and "bucket" in df.columns
            if partial:
                df = df.where(F.col("bucket").isin(list(touched)))
            w = df.write.format("parquet")
            (w.partitionBy("bucket") if "bucket" in df.columns else w).saveAsTable(f"{self.database}.{name}__next")
            steps.append((name, sorted(touched) if partial else None))
        self.spark.createDataFrame(steps, "name string, buckets array<int>").coalesce(1).write.format("parquet").saveAsTable(f"{self.database}.{READY}")
        self._swap(steps)

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.database}.{name}")

    def reset(self, schemas: dict[str, str] | None = None) -> None:
        """M9: an empty catalog, with empty tables of the given schemas."""
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")
        self._create()
        self.publish({n: self.spark.createDataFrame([], s) for n, s in (schemas or {}).items()})
