"""End-to-end incremental scan over a real folder tree."""

import os
import tempfile
import time
import uuid

from pyspark.sql import functions as F

from treeline.plans.pipelines import run_scan
from treeline.sources.store import CatalogStore


def _w(base, rel, text, mtime=None):
    p = os.path.join(base, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(text)
    if mtime:
        os.utime(p, (mtime, mtime))


def test_incremental_scan_pipeline(spark):
    base = tempfile.mkdtemp(prefix="treeline-base-")
    old = time.time() - 86400 * 10
    _w(base, "alpha/main.py", "a\nb\n", old)
    _w(base, "beta/lib.rs", "x\n", old)
    _w(base, "beta/README.md", "# beta\n", old)
    store = CatalogStore(spark, f"cat_{uuid.uuid4().hex[:8]}")
    remotes = spark.createDataFrame([("alpha", "git@github.com:o/alpha.git")], "name string, remote string")

    run_scan(spark, base, store, "2030-01-01 00:00:00", remotes)          # first scan: all new
    p = {r.name: r for r in store.read("projects").collect()}
    assert set(p) == {"alpha", "beta"} and p["alpha"].lines_of_code == 2 and p["beta"].primary_language == "rust"
    assert store.read("loc_history").count() == 2
    assert store.read("files").count() == 3

    # nothing changed: no project re-scanned, history unchanged
    run_scan(spark, base, store, "2030-01-02 00:00:00", remotes)
    assert store.read("loc_history").count() == 2
    logs = store.read("scan_logs").orderBy("started_at").collect()
    assert [r.projects_scanned for r in logs] == [2, 0]

    # alpha edited after the last scan (future mtime), gamma appears, beta removed
    future = time.time() + 86400 * 3650 * 5
    _w(base, "alpha/main.py", "a\nb\nc\n", future)
    _w(base, "gamma/x.go", "package x\n", old)
    os.rename(os.path.join(base, "beta"), os.path.join(base, ".trash-beta"))
    run_scan(spark, base, store, "2030-01-03 00:00:00", remotes)
    p = {r.name: r for r in store.read("projects").collect()}
    assert set(p) == {"alpha", "gamma"} and p["alpha"].lines_of_code == 3
    h = store.read("loc_history").groupBy("project_id").count().collect()
    assert sorted(r["count"] for r in h) == [1, 2]           # beta's history cascaded away
    assert store.read("files").where(F.col("project_id") == p["alpha"].id).count() == 1


def test_a_scan_opens_changed_projects_only_and_rewrites_their_buckets(spark):
    base = tempfile.mkdtemp(prefix="treeline-base-")
    old = time.time() - 86400 * 10
    for k in range(8):
        _w(base, f"p{k}/main.py", "a\n" * (k + 1), old)
        _w(base, f"p{k}/package.json", '{"dependencies": {"d%d": "1"}}' % k, old)
    store = CatalogStore(spark, f"cat_{uuid.uuid4().hex[:8]}")
    commits = spark.createDataFrame([(f"p{k}", f"{k}" * 40, f"{k}" * 7, "A", None, "m") for k in range(8)],
                                    "project string, sha string, short_sha string, author string, committed_at timestamp_ntz, message string")
    run_scan(spark, base, store, "2030-01-01 00:00:00", commits=commits)
    assert store.read("commits").count() == 8 and sorted(r.name for r in store.read("dependencies").collect()) == [f"d{k}" for k in range(8)]
    log = store.read("scan_logs").first()
    assert (log.projects_found, log.projects_scanned, log.files_read, log.file_errors) == (8, 8, 16, 0)

    def parts(name):
        return {r.f: r.b for r in store.read(name).select(F.input_file_name().alias("f"), F.col("bucket").alias("b")).distinct().collect()}
    before = {n: parts(n) for n in ("projects", "files", "commits", "loc_history")}
    # an unreadable file of an unchanged project would be an error if it were opened: it is not even looked at
    atimes = {k: os.stat(os.path.join(base, f"p{k}/main.py")).st_atime_ns for k in range(8)}
    future = time.time() + 86400 * 3650 * 5
    _w(base, "p3/main.py", "x\n" * 50, future)
    run_scan(spark, base, store, "2030-01-02 00:00:00", commits=commits)
    log = store.read("scan_logs").orderBy(F.desc("started_at")).first()
    assert (log.projects_found, log.projects_scanned, log.files_read) == (1, 1, 2)
    assert atimes == {k: os.stat(os.path.join(base, f"p{k}/main.py")).st_atime_ns for k in range(8) if k != 3} | {3: atimes[3]}
    p3 = {r.name: r for r in store.read("projects").collect()}["p3"]
    assert p3.lines_of_code == 50 and store.read("loc_history").where(F.col("project_id") == p3.id).count() == 2
    for n, was in before.items():
        now = parts(n)
        assert {f for f, b in now.items() if b != p3.bucket} == {f for f, b in was.items() if b != p3.bucket}
        assert not {f for f, b in now.items() if b == p3.bucket} & set(was)
    assert store.read("files").count() == 16 and store.read("commits").count() == 8


def test_errors_are_rows_of_the_scan(spark):
    base = tempfile.mkdtemp(prefix="treeline-base-")
    _w(base, "alpha/main.py", "a\n")
    _w(base, "alpha/src/lib.py", "b\n")
    os.symlink(os.path.join(base, "nowhere"), os.path.join(base, "alpha/src/broken.py"))
    store = CatalogStore(spark, f"cat_{uuid.uuid4().hex[:8]}")
    run_scan(spark, base, store, "2030-01-01 00:00:00")
    e = store.read("scan_errors").collect()
    assert [(r.project, r.path) for r in e] == [("alpha", "src/broken.py")] and "FileNotFoundError" in e[0].error
    assert store.read("scan_logs").first().error_count == 1
    assert store.read("projects").first().lines_of_code == 2
