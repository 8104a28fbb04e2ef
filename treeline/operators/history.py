"""Time-ordered catalog history: LOC deltas (W3), record-on-change (W4),
recent commits (W5), scan logs (S12, O6) and LOC history reads (O7).

Within a project the order is (time, id), so results are deterministic.  A
project's history may be huge, so "the previous row" is found per project and
month: windows cover one month, and the last row of the month before is
carried over from a small aggregate.  Per-project top-N reads use
``row_number() <= N``, which Spark plans as a partial WindowGroupLimit before
the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions import fixed


def with_previous(rows: DataFrame, value: str, project_col: str, time_col: str, id_col: str, period: str = "month") -> DataFrame:
    """``rows`` with ``_first`` (the project's first row) and ``_prev`` (the
    value of the row before, by time and id).  No window spans more than one
    project and period; null times are a period of their own, which comes first."""
    part = F.date_trunc(period, F.col(time_col).cast("timestamp_ntz"))
    d = rows.withColumn("_period", part)
    order = F.struct(F.col(time_col), F.col(id_col))
    ends = d.groupBy(project_col, "_period").agg(F.max_by(F.struct(value), order).alias("_end"))
    before = F.lag("_end").over(Window.partitionBy(project_col).orderBy("_period"))
    ends = ends.select(F.col(project_col).alias("_project"), F.col("_period").alias("_in"), before.alias("_before"))
    j = d.join(ends, F.col(project_col).eqNullSafe(F.col("_project")) & F.col("_period").eqNullSafe(F.col("_in")))
    w = Window.partitionBy(project_col, "_period").orderBy(time_col, id_col)
    opens = F.row_number().over(w) == 1
    j = j.withColumn("_opens", opens).withColumn("_lag", F.lag(value).over(w))
    return (j.withColumn("_first", F.col("_opens") & F.col("_before").isNull())
            .withColumn("_prev", F.when(F.col("_opens"), F.col("_before")[value]).otherwise(F.col("_lag")))
            .drop("_period", "_project", "_in", "_before", "_opens", "_lag"))


def loc_delta(history: DataFrame, project_col: str = "project_id", time_col: str = "recorded_at",
              id_col: str = "snapshot_id") -> DataFrame:
    """Change vs the previous snapshot; the first one is 'Initial'.

    ``change`` is '+1,234' / '-1,234' / '0' / 'Initial'.
    """
    d = with_previous(history, "lines_of_code", project_col, time_col, id_col)
    d = d.withColumn("delta", F.col("lines_of_code") - F.col("_prev")).drop("_first", "_prev")
    change = (F.when(F.col("delta").isNull(), F.lit("Initial"))
              .when(F.col("delta") > 0, F.concat(F.lit("+"), F.format_number(F.col("delta"), 0)))
              .when(F.col("delta") < 0, F.format_number(F.col("delta"), 0))
              .otherwise(F.lit("0")))
    return d.withColumn("change", change)


def record_on_change(snapshots: DataFrame, project_col: str = "project_id", time_col: str = "recorded_at",
                     id_col: str = "snapshot_id") -> DataFrame:
    """History rows a sequence of scans writes: the first scan of a
    project, then every scan whose LOC differs from the previous scan's."""
    d = with_previous(snapshots, "lines_of_code", project_col, time_col, id_col)
    return d.where(F.col("_first") | ~F.col("lines_of_code").eqNullSafe(F.col("_prev"))).drop("_first", "_prev")


def recent_commits(commits: DataFrame, n: int = fixed.RECENT_COMMITS) -> DataFrame:
    """Newest ``n`` commits per project (undated last, then by sha)."""
    w = Window.partitionBy("project").orderBy(F.desc_nulls_last("committed_at"), F.desc("sha"))
    return commits.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def loc_history(history: DataFrame, project_id, limit: int = 100, project_col: str = "project_id") -> DataFrame:
    """Newest ``limit`` history rows of one project."""
    if not 0 < limit <= fixed.HISTORY_MAX_LIMIT:
        raise ValueError(f"limit must be 1 to {fixed.HISTORY_MAX_LIMIT}")
    return (history.where(F.col(project_col) == project_id)
            .orderBy(F.desc("recorded_at"), F.desc("snapshot_id")).limit(limit))


def scan_logs(runs: DataFrame) -> DataFrame:
    """One log row per scan run.

    ``runs(run_id, started_at, completed_at, project, ok, error)`` holds one
    row per project visited by a run.  The messages are rows of their own
    (:func:`scan_errors`), all of them, so no run builds a huge array.
    """
    return runs.groupBy("run_id").agg(
        F.min("started_at").alias("started_at"),
        F.max("completed_at").alias("completed_at"),
        F.countDistinct("project").alias("projects_found"),
        F.count_if(F.col("ok")).alias("projects_scanned"),
        F.count_if(~F.col("ok")).alias("error_count"),
    )


def scan_errors(runs: DataFrame) -> DataFrame:
    """Every error of every run, as rows (run_id, project, error)."""
    return runs.where(~F.col("ok")).select("run_id", "project", "error")


def newest_scan_logs(logs: DataFrame, n: int = 20) -> DataFrame:
    """Newest ``n`` scan logs."""
    if not 0 < n <= fixed.SCAN_LOG_MAX_LIMIT:
        raise ValueError(f"n must be 1 to {fixed.SCAN_LOG_MAX_LIMIT}")
    return logs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def append_on_change(history: DataFrame, current: DataFrame, as_of, project_col: str = "project_id") -> DataFrame:
    """M6: rows to append to the LOC history after a scan -- projects never
    recorded, or whose current LOC differs from their latest recorded value.

    ``current(project_id, lines_of_code, file_count)``.  The latest value
    per project is a ``max_by`` aggregate (combined map-side), not a window.
    """
    last = history.groupBy(project_col).agg(
        F.max_by("lines_of_code", F.struct("recorded_at", "snapshot_id")).alias("_last"))
    j = current.join(last, project_col, "left")
    changed = F.col("_last").isNull() | ~F.col("lines_of_code").eqNullSafe(F.col("_last"))
    return (j.where(changed).drop("_last")
            .withColumn("recorded_at", F.lit(as_of).cast("timestamp_ntz")))
