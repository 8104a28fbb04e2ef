"""Catalog maintenance fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from treeline.operators import catalog as cat

T = dt.datetime


def _frames(spark):
    before = spark.createDataFrame([
        (1, "same", "/c/same", "r-same", T(2024, 1, 1), 10),
        (2, "changed", "/c/changed", None, T(2024, 1, 1), 20),
        (3, "old-name", "/c/old-name", "r-moved", T(2024, 1, 1), 30),
        (4, "stale-a", "/c/stale-a", "r-shared", T(2024, 1, 1), 40),
        (5, "stale-b", "/c/stale-b", "r-shared", T(2024, 1, 1), 50),
        (6, "orphan", "/c/orphan", None, T(2024, 1, 1), 60),
        (7, "equal-time", "/c/equal-time", None, T(2024, 1, 1), 70),
        (8, "no-files", "/c/no-files", None, T(2024, 1, 1), 80),
    ], "id long, name string, path string, git_remote_url string, scanned_at timestamp_ntz, lines_of_code long")
    disk = spark.createDataFrame([
        ("same", "/c/same", "r-same", T(2023, 12, 1)),
        ("changed", "/c/changed", None, T(2024, 2, 1)),
        ("new-name", "/c/new-name", "r-moved", T(2023, 6, 1)),
        ("z-shared", "/c/z-shared", "r-shared", T(2024, 3, 1)),
        ("b-shared", "/c/b-shared", "r-shared", T(2024, 3, 1)),
        ("brand-new", "/c/brand-new", None, T(2024, 3, 1)),
        ("equal-time", "/c/equal-time", None, T(2024, 1, 1)),
        ("no-files", "/c/no-files", None, None),
    ], "name string, path string, remote string, latest_mtime timestamp_ntz")
    return before, disk


def test_renames_orphans_and_changes(spark):
    before, disk = _frames(spark)
    ren = {(r.id, r.old_name, r.new_name) for r in cat.detect_renames(before, disk).collect()}
    # last stale project (id 5) wins the shared remote; first folder by name is taken
    assert ren == {(3, "old-name", "new-name"), (5, "stale-b", "b-shared")}
    orph = {r.id for r in cat.orphans(before, disk, cat.detect_renames(before, disk)).collect()}
    assert orph == {4, 6}
    renamed = cat.apply_renames(before, cat.detect_renames(before, disk)).join(
        cat.orphans(before, disk, cat.detect_renames(before, disk)).select("id"), "id", "left_anti")
    ch = {r.name: r.is_new for r in cat.changed_projects(disk, renamed).collect()}
    assert ch == {"changed": False, "b-shared": False, "z-shared": True, "brand-new": True}


def test_cascade_and_children(spark):
    kids = spark.createDataFrame([(1, "a"), (4, "b"), (6, "c")], "project_id long, v string")
    survivors = spark.createDataFrame([(1,), (4,)], "id long")
    assert sorted(r.v for r in cat.cascade(kids, survivors).collect()) == ["a", "b"]
    new = spark.createDataFrame([(1, "a2")], "project_id long, v string")
    out = cat.replace_children(kids, new, spark.createDataFrame([(1,)], "id long"))
    assert sorted(r.v for r in out.collect()) == ["a2", "b", "c"]


def test_upsert_idempotent_and_keeps_ids(spark):
    before, _ = _frames(spark)
    scanned = spark.createDataFrame([(100, "same", "/c/same", 11), (101, "fresh", "/c/fresh", 5)],
                                    "new_id long, name string, path string, lines_of_code long")
    once = cat.upsert(before, scanned, "2025-01-01 00:00:00")
    twice = cat.upsert(once, scanned, "2025-01-01 00:00:00")
    a = sorted(tuple(r) for r in once.select("id", "name", "lines_of_code", "updated_at").collect())
    b = sorted(tuple(r) for r in twice.select("id", "name", "lines_of_code", "updated_at").collect())
    assert a == b
    d = {r.name: (r.id, r.lines_of_code) for r in once.collect()}
    assert d["same"] == (1, 11) and d["fresh"] == (101, 5) and d["orphan"] == (6, 60)


def test_incremental_scan_preserves_renamed_id(spark):
    before, disk = _frames(spark)
    rows = disk.select(F.lit(None).cast("long").alias("new_id"), "name", "path",
                       F.lit(1).cast("long").alias("lines_of_code"))
    res = cat.incremental_scan(before, disk, rows, "2025-01-01 00:00:00")
    d = {r.name: r for r in res["catalog"].collect()}
    assert d["new-name"].id == 3 and "orphan" not in d and "stale-a" not in d
    assert d["same"].lines_of_code == 10 and d["changed"].lines_of_code == 1


def test_full_and_single_scan(spark):
    before, disk = _frames(spark)
    rows = disk.select(F.lit(None).cast("long").alias("new_id"), "name", "path",
                       F.lit(1).cast("long").alias("lines_of_code"))
    full = {r.name: r.lines_of_code for r in cat.full_scan(before, disk, rows, "2025-01-01 00:00:00").collect()}
    assert full["same"] == 1 and full["equal-time"] == 1 and "orphan" not in full
    one = {r.name: r.lines_of_code for r in cat.full_scan(before, disk, rows, "2025-01-01 00:00:00", only=["same"]).collect()}
    assert one["same"] == 1 and one["equal-time"] == 70


def test_scan_log_row_and_store_append(spark):
    import uuid

    from treeline.sources.store import CatalogStore

    before, disk = _frames(spark)
    rows = disk.select(F.lit(None).cast("long").alias("new_id"), "name", "path",
                       F.lit(1).cast("long").alias("lines_of_code"))
    res = cat.incremental_scan(before, disk, rows, "2025-01-01 00:00:00")
    errs = spark.createDataFrame([("b: boom",), ("a: fail",)], "error string")
    log = cat.scan_log_row(res, "incremental", "2025-01-01 00:00:00", "2025-01-01 00:05:00", "api", errs)
    r = log.collect()[0]
    assert (r.scan_type, r.projects_found, r.projects_scanned, r.error_count, r.triggered_by) == \
        ("incremental", 4, 4, 2, "api")
    store = CatalogStore(spark, f"cat_{uuid.uuid4().hex[:8]}")
    store.append("scan_logs", log)
    store.append("scan_logs", log)
    assert store.read("scan_logs").count() == 2
