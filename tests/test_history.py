"""History windows and the stateful stream."""

import datetime as dt
import os
import random
import tempfile

from pyspark.sql import functions as F

from treeline.operators import history, segments
from treeline.streaming import jobs

T = dt.datetime


def _snaps(spark, rows):
    return spark.createDataFrame(rows, "project_id long, snapshot_id long, recorded_at timestamp_ntz, "
                                       "lines_of_code long, file_count long")


ROWS = [(1, 1, T(2024, 1, 1), 1000, 50), (1, 2, T(2024, 1, 2), 1000, 50), (1, 3, T(2024, 1, 3), 1200, 51),
        (1, 4, T(2024, 1, 4), 900, 49), (2, 5, T(2024, 1, 1), 5, 1)]


def test_loc_delta_labels(spark):
    d = {r.snapshot_id: r.change for r in history.loc_delta(_snaps(spark, ROWS)).collect()}
    assert d == {1: "Initial", 2: "0", 3: "+200", 4: "-300", 5: "Initial"}


def test_record_on_change(spark):
    kept = sorted(r.snapshot_id for r in history.record_on_change(_snaps(spark, ROWS)).collect())
    assert kept == [1, 3, 4, 5]


def test_recent_commits_top15(spark):
    rows = [("p", f"{i:02d}", T(2024, 1, 1) + dt.timedelta(days=i)) for i in range(20)] + [("p", "zz", None)]
    df = spark.createDataFrame(rows, "project string, sha string, committed_at timestamp_ntz")
    got = [r.sha for r in history.recent_commits(df).orderBy("rn").collect()]
    assert got == [f"{i:02d}" for i in range(19, 4, -1)]


def test_stream_on_change_with_late_rows(spark):
    d = tempfile.mkdtemp(prefix="t2-")
    _snaps(spark, ROWS[:3]).coalesce(1).write.parquet(os.path.join(d, "in", "b0"))
    late = [(1, 9, T(2023, 12, 31), 7, 1), (1, 10, T(2024, 1, 5), 900, 49)]
    _snaps(spark, late).coalesce(1).write.parquet(os.path.join(d, "in", "b1"))
    schema = _snaps(spark, ROWS).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true") \
        .parquet(os.path.join(d, "in"))
    out = spark.read.parquet(jobs.stream_record_on_change(spark, stream, out_root=os.path.join(d, "out")))
    got = {r.snapshot_id: (r.recorded, r.late) for r in out.collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (True, False), 9: (False, True), 10: (True, False)}


def test_on_change_history_equals_batch_after_late_rows_and_a_restart(spark):
    """Rows in any order over several files and chunks; the stream is stopped and resumed between them."""
    rng = random.Random(5)
    rows = []
    for p in (1, 2, 3, None):
        for k in range(120):
            t = None if rng.random() < .03 else T(2024, 1, 1) + dt.timedelta(days=rng.randrange(150), hours=rng.randrange(3))
            rows.append((p, 1000 * (p or 0) + k, t, rng.choice([5, 6, None]), k))
    d = tempfile.mkdtemp(prefix="t2-restart-")
    schema = _snaps(spark, ROWS).schema
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for part in range(3):
            _snaps(spark, rows[part::3]).coalesce(1).write.parquet(os.path.join(d, "in", f"b{part}"))
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(os.path.join(d, "in"))
            path = jobs.stream_record_on_change(spark, stream, out_root=os.path.join(d, "out"))
            seen = [r for k, r in enumerate(rows) if k % 3 <= part]
            out = spark.read.parquet(path)
            assert out.count() == len(seen) and out.where("late").count() > 20
            want = sorted(r.snapshot_id for r in history.record_on_change(_snaps(spark, seen)).collect())
            assert sorted(r.snapshot_id for r in jobs.on_change_history(out).collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_append_on_change(spark):
    hist = _snaps(spark, ROWS)
    cur = spark.createDataFrame([(1, 900, 49), (2, 6, 1), (3, 1, 1)], "project_id long, lines_of_code long, file_count long")
    got = sorted(r.project_id for r in history.append_on_change(hist, cur, "2025-01-01 00:00:00").collect())
    assert got == [2, 3]


def test_a_streamed_table_may_be_a_file_or_a_folder(spark):
    """A table's folder holds files of any name; the index stream used to find none there and wrote no vectors."""
    from treeline.plans.registry import REGISTRY, load_all

    load_all()
    docs = spark.createDataFrame([(i, f"word{i} common text") for i in range(40)], "doc_id long, text string")
    folder, single = tempfile.mkdtemp(prefix="t5-folder-"), tempfile.mkdtemp(prefix="t5-file-")
    docs.repartition(3).write.parquet(os.path.join(folder, "documents.parquet"))
    docs.toPandas().to_parquet(os.path.join(single, "documents.parquet"))
    for d in (folder, single):
        stream = jobs.stream_table(spark, d, "documents.parquet", docs.schema)
        root = jobs.stream_index(spark, stream)
        assert segments.current(spark, root).count() == 40 and segments.current(spark, root, "vectors").count() == 40
        assert REGISTRY["t5_stream_vectors"](spark, d).select("doc_id").distinct().count() == 40
