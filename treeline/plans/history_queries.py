"""Registered history queries (S8, S9, S12, W3-W5, O6, O7) over ``events``
(commits, LOC snapshots, scan runs) and ``pages`` (remotes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.io import table
from treeline.operators import history
from treeline.plans.registry import register
from treeline.plans.standins import COMMITS_SQL, SNAPSHOTS_SQL, commit_lines, loc_snapshots
from treeline.sources import logs

O7_PROJECT = 7


@register("s8_commit_parse", "WITH " + COMMITS_SQL + """
SELECT project, sha, short_sha, author, committed_at, message FROM commits""")
def s8_commit_parse(spark, sf_dir):
    return logs.parse_commit_lines(commit_lines(spark, sf_dir))


@register("w5_recent_commits", "WITH " + COMMITS_SQL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY committed_at DESC NULLS LAST, sha DESC) AS rn
      FROM commits)
SELECT project, sha, author, committed_at, rn::INTEGER AS rn FROM r WHERE rn <= 15""")
def w5_recent_commits(spark, sf_dir):
    c = logs.parse_commit_lines(commit_lines(spark, sf_dir))
    return history.recent_commits(c, 15).select("project", "sha", "author", "committed_at", "rn")


_REMOTE = """CASE page_id % 6
    WHEN 0 THEN 'git@github.com:' || regexp_extract(url, '^https?://([^/.]+)', 1) || '/repo' || page_id::VARCHAR || '.git'
    WHEN 1 THEN 'https://github.com/' || regexp_extract(url, '^https?://([^/.]+)', 1) || '/repo' || page_id::VARCHAR || '.git'
    WHEN 2 THEN 'https://github.com/' || regexp_extract(url, '^https?://([^/.]+)', 1) || '/repo' || page_id::VARCHAR
    WHEN 3 THEN 'git@github.com:' || regexp_extract(url, '^https?://([^/.]+)', 1) || '/my.github.io.git'
    WHEN 4 THEN url
    ELSE NULL END"""


def _remotes(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    owner = F.regexp_extract("url", r"^https?://([^/.]+)", 1)
    pid = F.col("page_id").cast("string")
    m = F.col("page_id") % 6
    remote = (F.when(m == 0, F.concat(F.lit("git@github.com:"), owner, F.lit("/repo"), pid, F.lit(".git")))
              .when(m == 1, F.concat(F.lit("https://github.com/"), owner, F.lit("/repo"), pid, F.lit(".git")))
              .when(m == 2, F.concat(F.lit("https://github.com/"), owner, F.lit("/repo"), pid))
              .when(m == 3, F.concat(F.lit("git@github.com:"), owner, F.lit("/my.github.io.git")))
              .when(m == 4, F.col("url")))
    branch = F.when(F.col("page_id") % 2 == 0, F.lit("main")).otherwise(F.lit("master"))
    return p.select(F.col("page_id").alias("project_id"), remote.alias("remote_url"), branch.alias("branch"))


@register("s9_repo_identity", f"""
WITH r AS (SELECT page_id AS project_id, trim({_REMOTE}) AS remote_url,
                  CASE WHEN page_id % 2 = 0 THEN 'main' ELSE 'master' END AS default_branch FROM pages),
g AS (SELECT *, CASE WHEN starts_with(remote_url, 'git@') THEN string_split(remote_url, ':')[2]
                     WHEN contains(remote_url, 'github.com/') THEN string_split(remote_url, 'github.com/')[2]
                END AS raw FROM r)
SELECT project_id, remote_url, default_branch,
       CASE WHEN contains(remote_url, 'github.com') AND regexp_replace(raw, '\\.git$', '') <> ''
            THEN regexp_replace(raw, '\\.git$', '') END AS github_name,
       remote_url IS NOT NULL AS is_repo
FROM g""")
def s9_repo_identity(spark, sf_dir):
    return logs.repo_identity(_remotes(spark, sf_dir))


@register("w3_loc_delta", "WITH " + SNAPSHOTS_SQL + """,
d AS (SELECT *, lines_of_code - lag(lines_of_code) OVER (PARTITION BY project_id ORDER BY recorded_at, snapshot_id) AS delta
      FROM snaps)
SELECT project_id, snapshot_id, recorded_at, lines_of_code, delta,
       CASE WHEN delta IS NULL THEN 'Initial' WHEN delta > 0 THEN '+' || format('{:,}', delta)
            WHEN delta < 0 THEN format('{:,}', delta) ELSE '0' END AS change
FROM d""")
def w3_loc_delta(spark, sf_dir):
    return history.loc_delta(loc_snapshots(spark, sf_dir)).select(
        "project_id", "snapshot_id", "recorded_at", "lines_of_code", "delta", "change")


@register("w4_on_change", "WITH " + SNAPSHOTS_SQL + """,
d AS (SELECT *, lag(lines_of_code) OVER (PARTITION BY project_id ORDER BY recorded_at, snapshot_id) AS prev,
             row_number() OVER (PARTITION BY project_id ORDER BY recorded_at, snapshot_id) AS rn
      FROM snaps)
SELECT project_id, snapshot_id, recorded_at, lines_of_code, file_count FROM d
WHERE rn = 1 OR lines_of_code IS DISTINCT FROM prev""")
def w4_on_change(spark, sf_dir):
    return history.record_on_change(loc_snapshots(spark, sf_dir)).select(
        "project_id", "snapshot_id", "recorded_at", "lines_of_code", "file_count")


@register("o7_loc_history", "WITH " + SNAPSHOTS_SQL + f"""
SELECT project_id, snapshot_id, recorded_at, lines_of_code FROM snaps WHERE project_id = {O7_PROJECT}
ORDER BY recorded_at DESC, snapshot_id DESC LIMIT 100""")
def o7_loc_history(spark, sf_dir):
    return history.loc_history(loc_snapshots(spark, sf_dir), O7_PROJECT, 100).select(
        "project_id", "snapshot_id", "recorded_at", "lines_of_code")


def _runs(spark, sf_dir):
    """One scan run per calendar day of events; each event = one project visit."""
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    return e.select(
        F.date_format(day, "yyyyMMdd").cast("long").alias("run_id"),
        F.col("ts").alias("started_at"),
        F.col("ts").alias("completed_at"),
        F.col("user_id").alias("project"),
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") == "error",
               F.concat(F.col("user_id").cast("string"), F.lit(": failed "), F.col("event_id").cast("string"))).alias("error"),
    )


_RUNS_SQL = """runs AS (
  SELECT strftime(ts::DATE, '%Y%m%d')::BIGINT AS run_id, ts AS started_at, ts AS completed_at, user_id AS project,
         event_type <> 'error' AS ok,
         CASE WHEN event_type = 'error' THEN user_id::VARCHAR || ': failed ' || event_id::VARCHAR END AS error
  FROM events),
logs AS (
  SELECT run_id, min(started_at) AS started_at, max(completed_at) AS completed_at,
         count(DISTINCT project)::BIGINT AS projects_found,
         count(*) FILTER (WHERE ok)::BIGINT AS projects_scanned,
         count(*) FILTER (WHERE NOT ok)::BIGINT AS error_count
  FROM runs GROUP BY run_id)"""


@register("s12_scan_log", "WITH " + _RUNS_SQL + """
SELECT * FROM logs""")
def s12_scan_log(spark, sf_dir):
    return history.scan_logs(_runs(spark, sf_dir))


@register("s12_scan_errors", "WITH " + _RUNS_SQL + "\nSELECT run_id, project, error FROM runs WHERE NOT ok")
def s12_scan_errors(spark, sf_dir):
    return history.scan_errors(_runs(spark, sf_dir))


@register("o6_scan_logs", "WITH " + _RUNS_SQL + """
SELECT run_id, started_at, projects_scanned FROM logs ORDER BY started_at DESC, run_id DESC LIMIT 20""")
def o6_scan_logs(spark, sf_dir):
    return history.newest_scan_logs(history.scan_logs(_runs(spark, sf_dir)), 20).select(
        "run_id", "started_at", "projects_scanned")
