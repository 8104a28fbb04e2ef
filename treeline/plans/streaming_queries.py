"""Registered streaming queries (T1-T5): each runs its stream to the end
(``availableNow``) over the driver tables and returns the sink table; the
oracle is the batch result of the same job."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.io import table
from treeline.operators import segments
from treeline.plans import oracle, vector_queries  # noqa: F401  (the SQL of x3_embed)
from treeline.plans.catalog_queries import AS_OF
from treeline.plans.registry import ORACLE, register
from treeline.plans.standins import COMMITS_SQL, SEP, catalog_before, disk_after
from treeline.session import scratch_path
from treeline.sources import logs
from treeline.streaming import jobs


def _events_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return jobs.stream_table(spark, sf_dir, "events.parquet", schema)


@register("t1_stream_scan", ORACLE["m3_incremental"])
def t1_stream_scan(spark, sf_dir):
    root = scratch_path(spark, "t1")
    snap = disk_after(spark, sf_dir).withColumn("snapshot_id", F.lit(0))
    snap.write.mode("overwrite").parquet(f"{root}/inventory/snapshot-0")
    # the listing's files all belong to one snapshot and arrive in one micro-batch
    stream = spark.readStream.schema(snap.schema).parquet(f"{root}/inventory/snapshot-0")
    out = jobs.stream_incremental_scan(
        spark, stream, catalog_before(spark, sf_dir),
        lambda disk: disk.select("new_id", "name", "path", "lines_of_code"), AS_OF, out_root=f"{root}/catalog")
    return jobs.read_latest(spark, out).select("id", "name", "path", "lines_of_code", "scanned_at", "git_remote_url")


@register("t2_stream_on_change", ORACLE["w4_on_change"])
def t2_stream_on_change(spark, sf_dir):
    e = _events_stream(spark, sf_dir)
    snaps = e.select(
        F.col("user_id").alias("project_id"), F.col("event_id").alias("snapshot_id"),
        F.col("ts").alias("recorded_at"), F.floor(F.col("value") * 100).cast("long").alias("lines_of_code"),
        (F.col("event_id") % 97).alias("file_count"))
    path = jobs.stream_record_on_change(spark, snaps)
    return jobs.on_change_history(spark.read.parquet(path))


@register("t3_commit_dedup", "WITH " + COMMITS_SQL + """
SELECT project, sha, author, committed_at, message FROM commits""")
def t3_commit_dedup(spark, sf_dir):
    e = _events_stream(spark, sf_dir)
    e = e.unionByName(_events_stream(spark, sf_dir).where(F.col("event_id") % 5 == 0))
    lines = _lines_from_events(e)
    parsed = logs.parse_commit_lines(lines, keep=["event_time"])
    path = jobs.stream_commit_dedup(spark, parsed)
    return spark.read.parquet(path).select("project", "sha", "author", "committed_at", "message")


def _lines_from_events(e):
    i = F.col("event_id")
    wall = F.when(i % 3 == 0, F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(2))).otherwise(F.col("ts"))
    off = F.when(i % 3 == 0, F.lit("+02:00")).when(i % 3 == 1, F.lit("Z")).otherwise(F.lit("+00:00"))
    date = F.when(i % 13 == 0, F.lit("not-a-date")).otherwise(F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), off))
    line = F.concat_ws(SEP, F.lpad(F.hex(i), 40, "0"), F.lpad(F.hex(i), 7, "0"),
                       F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("event_type")),
                       date, F.concat(F.lit("update: "), F.col("props")))
    line = F.when(i % 17 == 0, F.concat(line, F.lit(SEP + "extra"))).otherwise(line)
    line = F.when(i % 19 == 0, F.lit("  ")).otherwise(line)
    return e.select(F.col("user_id").alias("project"), line.alias("value"),
                    jobs.ntz_as_utc_instant(F.col("ts")).alias("event_time"))


@register("t4_activity", """
SELECT user_id AS project, date_trunc('day', ts) AS day_start, count(*)::BIGINT AS commits
FROM events GROUP BY 1, 2""")
def t4_activity(spark, sf_dir):
    e = _events_stream(spark, sf_dir)
    c = e.select(F.col("user_id").alias("project"), jobs.ntz_as_utc_instant(F.col("ts")).alias("event_time"),
                 F.to_date("ts").alias("day"))
    root = jobs.stream_daily_activity(spark, c, extra_keys=["day"])
    return jobs.read_latest(spark, root).select(
        "project", F.col("day").cast("timestamp_ntz").alias("day_start"), F.col("commits").cast("long").alias("commits"))


def _indexed_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "documents").schema
    docs = jobs.stream_table(spark, sf_dir, "documents.parquet", schema)
    return jobs.stream_index(spark, docs.select("doc_id", "text"))


@register("t5_stream_index", oracle.ORACLE["x1_postings"])
def t5_stream_index(spark, sf_dir):
    root = _indexed_stream(spark, sf_dir)
    return segments.current(spark, root, "postings").select("doc_id", "field", "pos", "token", "dl")


@register("t5_stream_vectors", ORACLE["x3_embed"].replace("round(tf / sqrt(", "round((tf / sqrt(").replace("(PARTITION BY doc_id)), 6)", "(PARTITION BY doc_id)))::FLOAT::DOUBLE, 6)"))
def t5_stream_vectors(spark, sf_dir):
    """The vectors that the index stream stores, as (bucket, weight) of their non-zero places."""
    v = segments.current(spark, _indexed_stream(spark, sf_dir), "vectors")
    each = v.select("doc_id", F.posexplode("embedding").alias("bucket", "weight")).where("weight <> 0")
    return each.select("doc_id", "bucket", F.round(F.col("weight").cast("double"), 6).alias("weight"))
