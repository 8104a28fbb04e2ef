"""The catalog store survives a crash at every step of a publish."""

import uuid

import pytest

from treeline.sources.store import READY, CatalogStore


class Crash(Exception):
    pass


def _store(spark):
    return CatalogStore(spark, f"crash_{uuid.uuid4().hex[:8]}")


def _rows(store, name):
    return sorted(r.id for r in store.read(name).collect())


@pytest.mark.parametrize("step", range(12))
def test_publish_is_all_or_nothing(spark, monkeypatch, step):
    store = _store(spark)
    store.publish({"a": spark.range(7), "b": spark.range(3)})
    calls, real_sql = [0], spark.sql

    class Wrapped:
        """The session, which dies at the given statement."""

        def __getattr__(self, k):
            return getattr(spark, k)

        def sql(self, text):
            calls[0] += 1
            if calls[0] > step:
                raise Crash
            return real_sql(text)
    store.spark = Wrapped()
    try:
        store.publish({"a": spark.range(100, 104), "b": spark.range(200, 201), "c": spark.range(1)})
        done = True
    except Crash:
        done = False
    written = READY in {t.name for t in spark.catalog.listTables(store.database)}
    again = CatalogStore(spark, store.database, store.location)
    if done or written:
        assert again.tables() == ["a", "b", "c"] and _rows(again, "a") == [100, 101, 102, 103] and _rows(again, "b") == [200]
    else:
        assert again.tables() == ["a", "b"] and _rows(again, "a") == list(range(7)) and _rows(again, "b") == [0, 1, 2]
    assert not [t.name for t in spark.catalog.listTables(store.database) if t.name.endswith(("__next", "__ready"))]


def test_a_crash_while_tables_are_written_changes_nothing(spark):
    store = _store(spark)
    store.publish({"a": spark.range(7)})
    bad = spark.range(3).selectExpr("id", "raise_error('no') AS x")
    with pytest.raises(Exception):
        store.publish({"a": spark.range(1), "b": bad})
    again = CatalogStore(spark, store.database, store.location)
    assert again.tables() == ["a"] and _rows(again, "a") == list(range(7))
    again.publish({"a": again.read("a").where("id < 2")})
    assert _rows(again, "a") == [0, 1]


def test_touched_buckets_only(spark):
    from pyspark.sql import functions as F

    store = _store(spark)
    rows = spark.range(40).select("id", F.lit(1).alias("v"), (F.col("id") % 4).cast("int").alias("bucket"))
    store.publish({"t": rows})

    def files(b):
        return {r.f for r in store.read("t").where(F.col("bucket") == b).select(F.input_file_name().alias("f")).distinct().collect()}
    before = {b: files(b) for b in range(4)}
    old = store.read("t")
    # bucket 1 gets new values, bucket 2 loses all rows, a row of bucket 3 must not be written
    new = old.where("bucket <> 2").withColumn("v", F.when(F.col("bucket") == 1, F.lit(7)).otherwise(F.lit(9)))
    store.publish({"t": new}, touched=[1, 2])
    assert {(r.bucket, r.v): r["count"] for r in store.read("t").groupBy("bucket", "v").count().collect()} == {(0, 1): 10, (1, 7): 10, (3, 1): 10}
    assert files(0) == before[0] and files(3) == before[3] and not files(1) & before[1]
    # a crash after the buckets were written, before they took their place
    rows = spark.range(4).select("id", F.lit(5).alias("v"), F.lit(0).alias("bucket"))
    rows.write.format("parquet").partitionBy("bucket").saveAsTable(f"{store.database}.t__next")
    spark.createDataFrame([("t", [0])], "name string, buckets array<int>").write.format("parquet").saveAsTable(f"{store.database}.{READY}")
    again = CatalogStore(spark, store.database, store.location)
    assert again.read("t").where("bucket = 0").agg(F.sum("v")).first()[0] == 20 and again.read("t").count() == 24
