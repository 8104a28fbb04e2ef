"""Structured Streaming variants of the catalog jobs.

* T1 ``stream_incremental_scan``: each arriving inventory snapshot is
  diffed against the catalog (renames, orphans, changed set, upsert).
* T2 ``stream_record_on_change``: LOC history rows per project, judged by a
  stateful processor against the newest row (``transformWithStateInPandas``,
  RocksDB state); rows that come late are marked, and ``on_change_history``
  splices them in and judges their successors again.
* T3 ``stream_commit_dedup``: commits deduplicated on (project, sha) within
  a watermark.
* T4 ``stream_daily_activity``: commits per project and day (event-time
  window, watermark, update mode, upserted into the sink table).
* T5 ``stream_index``: new documents -> postings and vectors, an index segment per micro-batch.

Sinks are Parquet folders below the shared checkpoint folder.  Every
``foreachBatch`` writes to a folder named by its batch id with overwrite,
so a batch replayed after a failure rewrites the same output
(idempotent); stateful operators keep their state in the checkpoint.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.session import is_folder, scratch_path


def stream_table(spark: SparkSession, folder: str, name: str, schema, max_files: int | None = None) -> DataFrame:
    """A Parquet table as a streaming source: one file ``name`` in the folder,
    several whose names begin with it, or a folder of that name."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    # the filter looks at the files' own names, which in a table's folder aren't the table's
    inner = f"{folder.rstrip('/')}/{name}"
    return r.parquet(inner) if is_folder(spark, inner) else r.option("pathGlobFilter", f"{name}*").parquet(folder)


def run_available(query_builder: Callable[[str], object]) -> None:
    """Start a query with ``trigger(availableNow=True)`` and wait for it."""
    q = query_builder("availableNow")
    q.awaitTermination()
    exc = q.exception()
    if exc is not None:
        raise RuntimeError(str(exc))


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Batch ids of the ``v=<id>`` folders below ``root`` (any Hadoop file system)."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("v=") and name[2:].isdigit() and fs.exists(sc._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name[2:]))
    return sorted(out)


def _latest_version(spark: SparkSession, root: str, before: int) -> DataFrame | None:
    """The newest complete version written by a batch earlier than ``before``."""
    vs = [v for v in _versions(spark, root) if v < before]
    return spark.read.parquet(f"{root}/v={vs[-1]}") if vs else None


# ------------------------------------------------------------------- T1

def stream_incremental_scan(spark: SparkSession, snapshots: DataFrame, initial_catalog: DataFrame,
                            scan_rows_of: Callable[[DataFrame], DataFrame], as_of, out_root: str | None = None) -> str:
    """Apply M3 to every inventory snapshot of the stream.

    ``snapshots`` is a stream of complete disk listings tagged with
    ``snapshot_id`` (one snapshot may span several files but never several
    micro-batches: use one file per snapshot and ``maxFilesPerTrigger``).
    The catalog after batch ``b`` is written to ``<root>/v=<b>``.
    Returns the root folder.
    """
    from treeline.operators import catalog as cat

    root = out_root or scratch_path(spark, "catalog-stream")
    initial_path = f"{root}/initial"
    initial_catalog.write.mode("overwrite").parquet(initial_path)

    def apply(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        prev = _latest_version(s, root, batch_id)
        current = prev if prev is not None else s.read.parquet(initial_path)
        for (sid,) in batch.select("snapshot_id").distinct().orderBy("snapshot_id").collect():
            disk = batch.where(F.col("snapshot_id") == sid).drop("snapshot_id")
            res = cat.incremental_scan(current, disk, scan_rows_of(disk), as_of)
            current = res["catalog"]
        current.write.mode("overwrite").parquet(f"{root}/v={batch_id}")

    ck = f"{root}/_checkpoint"
    run_available(lambda _: snapshots.writeStream.foreachBatch(apply).option("checkpointLocation", ck)
                  .trigger(availableNow=True).start())
    return root


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    v = _latest_version(spark, root, 1 << 30)
    return v if v is not None else spark.read.parquet(f"{root}/initial")


# ------------------------------------------------------------------- T2

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
T2_OUT = ("project_id long, snapshot_id long, recorded_at timestamp_ntz, lines_of_code long, "
          "file_count long, recorded boolean, late boolean")


def _on_change_processor():
    """The D5 stateful processor of T2 (made where pandas is at hand)."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class RecordOnChange(StatefulProcessor):
        """Judges LOC snapshots of one project as they arrive.

        State: time, id and LOC of the newest row judged.  Rows come in
        chunks of one Arrow batch; a chunk is put in order by (recorded_at,
        snapshot_id) and judged against the state, so a project's rows are
        never held together.  A row older than the state, and one without a
        time, is passed on as late: it neither changes the state nor history.
        """

        def init(self, handle) -> None:
            self.newest = handle.getValueState("newest", "time timestamp_ntz, id long, loc long")

        def handleInputRows(self, key, rows, timerValues):
            newest = self.newest.get() if self.newest.exists() else None
            for chunk in rows:
                if not len(chunk):
                    continue
                chunk = chunk.sort_values(["recorded_at", "snapshot_id"], kind="mergesort")
                late = chunk["recorded_at"].isna()
                if newest is not None:
                    at, last = chunk["recorded_at"], pd.Timestamp(newest[0])
                    late |= (at < last) | ((at == last) & (chunk["snapshot_id"] < newest[1]))
                on_time = chunk[~late]
                recorded = pd.Series(False, index=chunk.index)
                if len(on_time):
                    loc, before = on_time["lines_of_code"], on_time["lines_of_code"].shift(1)
                    differs = (loc != before) & ~(loc.isna() & before.isna())
                    first = loc.iloc[0]
                    differs.iloc[0] = newest is None or (not pd.isna(first) if newest[2] is None else pd.isna(first) or first != newest[2])
                    recorded[on_time.index] = differs
                    tail = on_time.iloc[-1]
                    newest = (tail["recorded_at"].to_pydatetime(), int(tail["snapshot_id"]), None if pd.isna(tail["lines_of_code"]) else int(tail["lines_of_code"]))
                yield chunk.assign(recorded=recorded, late=late)[["project_id", "snapshot_id", "recorded_at", "lines_of_code", "file_count", "recorded", "late"]]
            if newest is not None:
                self.newest.update(newest)

        def close(self) -> None:
            pass

    return RecordOnChange()


def stream_record_on_change(spark: SparkSession, snapshots: DataFrame, out_root: str | None = None) -> str:
    """Record-on-change over a stream of LOC snapshots, by a stateful
    processor (``transformWithStateInPandas``, state in RocksDB).

    ``snapshots(project_id, snapshot_id, recorded_at timestamp, lines_of_code, file_count)``.
    Every row reaches the sink with ``recorded`` (its LOC differs from the
    row judged before it) and ``late`` (it came after a newer one was
    judged).  :func:`on_change_history` reads the history back with the late
    rows put in their place.  Calling again with the same root goes on from
    the checkpoint.  Returns the sink's folder.
    """
    root = out_root or scratch_path(spark, "loc-history-stream")
    columns = ["project_id", "snapshot_id", "recorded_at", "lines_of_code", "file_count"]
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKSDB)
    try:
        res = snapshots.select(*columns).groupBy("project_id").transformWithStateInPandas(_on_change_processor(), T2_OUT, "Append", "None")
        run_available(lambda _: res.writeStream.format("parquet").option("path", f"{root}/out")
                      .option("checkpointLocation", f"{root}/_checkpoint").outputMode("append")
                      .trigger(availableNow=True).start())
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
    return f"{root}/out"


def on_change_history(rows: DataFrame, period: str = "month") -> DataFrame:
    """The history of T2's sink with late rows spliced in: equals W4 over all rows.

    Only the periods of a project that late rows fall in are judged again,
    and the first row after such a period; every other row keeps the
    stream's verdict.  The ends of periods are combined map-side, windows
    cover one project and period.
    """
    d = rows.withColumn("_period", F.date_trunc(period, "recorded_at"))
    order = F.struct("recorded_at", "snapshot_id")
    # every period of the projects with late rows: its first row, its last LOC, whether it has late rows
    some = rows.where("late").select(F.col("project_id").alias("_late_in")).distinct()
    ends = d.join(some, F.col("project_id").eqNullSafe(F.col("_late_in")), "left_semi").groupBy("project_id", "_period").agg(
        F.max_by(F.struct("lines_of_code"), order).alias("_end"), F.min(order).alias("_opener"), F.max("late").alias("_again"))
    w = Window.partitionBy("project_id").orderBy("_period")
    ends = ends.withColumn("_before", F.lag("_end").over(w)).withColumn("_follows", F.coalesce(F.lag("_again").over(w), F.lit(False)))
    ends = ends.where(F.col("_again") | F.col("_follows")).select(
        F.col("project_id").alias("_project"), F.col("_period").alias("_in"), "_opener", "_before", "_again")
    j = d.join(ends, F.col("project_id").eqNullSafe(F.col("_project")) & F.col("_period").eqNullSafe(F.col("_in")), "left")
    within = Window.partitionBy("project_id", "_period").orderBy("recorded_at", "snapshot_id")
    opens = order == F.col("_opener")
    differs = ~F.col("lines_of_code").eqNullSafe(F.when(F.col("_opens"), F.col("_before.lines_of_code")).otherwise(F.col("_lag")))
    again = (j.where("_again").withColumn("_lag", F.lag("lines_of_code").over(within)).withColumn("_opens", F.row_number().over(within) == 1)
             .withColumn("recorded", (F.col("_opens") & F.col("_before").isNull()) | differs))
    rest = j.where("_again is null or not _again").withColumn(
        "recorded", F.when(F.coalesce(opens, F.lit(False)), F.col("_before").isNull() | ~F.col("lines_of_code").eqNullSafe(F.col("_before.lines_of_code"))).otherwise(F.col("recorded")))
    columns = ["project_id", "snapshot_id", "recorded_at", "lines_of_code", "file_count"]
    return again.where("recorded").select(*columns).unionByName(rest.where("recorded").select(*columns))


# ------------------------------------------------------------------- T3

def stream_commit_dedup(spark: SparkSession, commits: DataFrame, event_time: str = "event_time",
                        delay: str = "1 day", out_root: str | None = None) -> str:
    """Drop repeated (project, sha) pairs arriving within ``delay``."""
    root = out_root or scratch_path(spark, "commit-dedup-stream")
    d = commits.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["project", "sha"])
    run_available(lambda _: d.writeStream.format("parquet").option("path", f"{root}/out")
                  .option("checkpointLocation", f"{root}/_checkpoint").outputMode("append")
                  .trigger(availableNow=True).start())
    return f"{root}/out"


# ------------------------------------------------------------------- T4

def stream_daily_activity(spark: SparkSession, commits: DataFrame, event_time: str = "event_time",
                          delay: str = "1 day", out_root: str | None = None,
                          extra_keys: list[str] | None = None) -> str:
    """T4: commits per project per day.

    Update mode keeps state bounded by the watermark; each batch's updated
    counts (by project, day and extra keys) replace the previous ones in the sink table,
    written as version ``v=<batch_id>``.
    """
    root = out_root or scratch_path(spark, "activity-stream")
    agg = (commits.withWatermark(event_time, delay)
           .groupBy("project", F.window(event_time, "1 day").alias("w"), *(extra_keys or []))
           .agg(F.count(F.lit(1)).alias("commits"))
           .select("project", F.col("w.start").alias("day_start"), *(extra_keys or []), "commits"))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        prev = _latest_version(s, root, batch_id)
        cur = batch
        if prev is not None:
            keys = ["project", "day_start", *(extra_keys or [])]
            cur = prev.join(batch.select(*keys), keys, "left_anti").unionByName(batch)
        cur.write.mode("overwrite").parquet(f"{root}/v={batch_id}")

    run_available(lambda _: agg.writeStream.foreachBatch(upsert).outputMode("update")
                  .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    return root


# ------------------------------------------------------------------- T5

#: Distance of the segment numbers of two batches; merges and refreshes take the numbers between.
SEGMENT_STEP = 1000


def stream_index(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", fields=("text",),
                 out_root: str | None = None, dim: int = 384) -> str:
    """T5: postings and vectors of arriving documents, one index segment per
    micro-batch, numbered by it: a replayed batch writes the same segment
    again.  A document's latest batch replaces its earlier rows; of several
    rows with one id in a batch, one is taken.  Small segments are merged
    after the stream has ended.  Returns the index folder (see
    :mod:`treeline.operators.segments`)."""
    from treeline.operators import segments, vectors

    root = out_root or scratch_path(spark, "index-stream")

    def embed(rows: DataFrame) -> DataFrame:
        text = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.concat_ws(" ", *fields).alias("text"))
        return vectors.embed_hashed(text, "text", dim=dim, id_cols=["doc_id"]).drop("text")

    def index(batch: DataFrame, batch_id: int) -> None:
        segments.add_segment(batch.sparkSession, root, batch.dropDuplicates([id_col]), id_col, fields, segment=(batch_id + 1) * SEGMENT_STEP, embed=embed)

    run_available(lambda _: docs.writeStream.foreachBatch(index)
                  .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    segments.merge(spark, root)
    return root


def ntz_as_utc_instant(ntz):
    """Event time for watermarks from a naive (NTZ) timestamp, reading the
    wall clock as UTC whatever the session time zone is, so event-time
    windows line up with the naive calendar days."""
    days = F.datediff(F.to_date(ntz), F.lit("1970-01-01").cast("date")).cast("long")
    secs = F.hour(ntz).cast("long") * 3600 + F.minute(ntz).cast("long") * 60
    micros = (F.second(ntz).cast("long") * 1_000_000
              + F.date_format(ntz, "SSSSSS").cast("long"))
    return F.timestamp_micros(days * 86_400_000_000 + secs * 1_000_000 + micros)
