"""Catalog maintenance: renames (J5, M5), change detection (J6, J9),
orphan removal with cascade (J7), upserts (M1), child replacement (M2)
and the incremental scan (M3).

Inputs:

* ``catalog(id, name, path, git_remote_url, scanned_at, ...)`` -- stored projects;
* ``disk(name, path, remote, latest_mtime)`` -- discovered project folders
  with their origin remote and latest eligible mtime (A4); ``latest_mtime``
  is null for a folder without an eligible file.

Every step is a join or a grouped aggregation keyed by name, path, id or
remote.  Per-remote choices ("last stale project wins", "first folder by
name wins") are max/min aggregations, combined map-side, so a remote shared
by many rows never lands whole in one task.  No per-project loop exists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale_projects(catalog: DataFrame, disk: DataFrame) -> DataFrame:
    """Catalog rows whose folder no longer exists."""
    return catalog.join(disk.select("path"), "path", "left_anti")


def detect_renames(catalog: DataFrame, disk: DataFrame) -> DataFrame:
    """(id, old_name, new_name, new_path, remote).

    A stale project with a remote is matched to a folder of unknown name
    with the same remote.  Per remote, the stale project with the highest
    id wins (it was inserted last) and the first unknown folder by name is
    taken; each remote is used once.
    """
    stale = stale_projects(catalog, disk).where(F.col("git_remote_url").isNotNull())
    s = (stale.groupBy(F.col("git_remote_url").alias("remote"))
         .agg(F.max(F.struct("id", "name")).alias("s"))
         .select("remote", F.col("s.id").alias("id"), F.col("s.name").alias("old_name")))
    unknown = disk.join(catalog.select("name"), "name", "left_anti").where(F.col("remote").isNotNull())
    d = (unknown.groupBy("remote").agg(F.min(F.struct("name", "path")).alias("d"))
         .select("remote", F.col("d.name").alias("new_name"), F.col("d.path").alias("new_path")))
    return s.join(d, "remote").select("id", "old_name", "new_name", "new_path", "remote")


def apply_renames(catalog: DataFrame, renames: DataFrame) -> DataFrame:
    """M5: renamed projects keep their id (children stay attached)."""
    r = renames.select("id", "new_name", "new_path")
    j = catalog.join(r, "id", "left")
    return (j.withColumn("name", F.coalesce("new_name", "name"))
            .withColumn("path", F.coalesce("new_path", "path"))
            .drop("new_name", "new_path"))


def orphans(catalog: DataFrame, disk: DataFrame, renames: DataFrame) -> DataFrame:
    """Stale projects that no rename claimed."""
    return stale_projects(catalog, disk).join(renames.select("id"), "id", "left_anti")


def cascade(children: DataFrame, survivors: DataFrame, key: str = "project_id") -> DataFrame:
    """J7 cascade: child rows whose parent survived (postings, vectors and
    history included -- every child table goes through this)."""
    return children.join(survivors.select(F.col("id").alias(key)), key, "left_semi")


def changed_projects(disk: DataFrame, catalog: DataFrame) -> DataFrame:
    """Folders to scan: new, never scanned, or modified since the
    last scan.  Folders without an eligible file are skipped.

    Output: name, path, latest_mtime, scanned_at, is_new.
    """
    known = catalog.select("name", "scanned_at", F.lit(True).alias("_known"))
    j = disk.where(F.col("latest_mtime").isNotNull()).join(known, "name", "left")
    keep = F.col("scanned_at").isNull() | (F.col("latest_mtime") > F.col("scanned_at"))
    return (j.where(keep)
            .select("name", "path", "latest_mtime", "scanned_at", F.col("_known").isNull().alias("is_new")))


def upsert(catalog: DataFrame, scanned: DataFrame, as_of, key: str = "name", new_id_col: str = "new_id") -> DataFrame:
    """M1: insert or update projects by ``key``.

    Scan columns of ``scanned`` replace the stored ones; ids of existing
    projects are kept, inserted projects take ``new_id_col``; ``updated_at``
    becomes ``as_of`` on touched rows, ``created_at`` is set on inserts.
    Applying the same scan twice gives the same catalog.
    """
    as_of = F.lit(as_of).cast("timestamp_ntz") if not hasattr(as_of, "alias") else as_of
    cat = catalog
    for c in ("created_at", "updated_at"):
        if c not in cat.columns:
            cat = cat.withColumn(c, F.lit(None).cast("timestamp_ntz"))
    scan_cols = [c for c in scanned.columns if c not in (key, new_id_col)]
    o = cat.select(*[F.col(c).alias("o_" + c) for c in cat.columns])
    n = scanned.select(*[F.col(c).alias("n_" + c) for c in scanned.columns], F.lit(True).alias("_hit"))
    j = o.join(n, o["o_" + key] == n["n_" + key], "full_outer")
    hit = F.col("_hit").isNotNull()
    out = [F.coalesce(F.col("o_id"), F.col("n_" + new_id_col)).alias("id"),
           F.coalesce(F.col("n_" + key), F.col("o_" + key)).alias(key)]
    for c in cat.columns:
        if c in ("id", key, "created_at", "updated_at"):
            continue
        if c in scan_cols:
            out.append(F.when(hit, F.col("n_" + c)).otherwise(F.col("o_" + c)).alias(c))
        else:
            out.append(F.col("o_" + c).alias(c))
    for c in scan_cols:
        if c not in cat.columns:
            out.append(F.col("n_" + c).alias(c))
    out.append(F.coalesce(F.col("o_created_at"), F.when(hit, as_of)).alias("created_at"))
    out.append(F.when(hit, as_of).otherwise(F.col("o_updated_at")).alias("updated_at"))
    return j.select(*out)


def replace_children(old: DataFrame, new: DataFrame, scanned_ids: DataFrame, key: str = "project_id") -> DataFrame:
    """M2: children of re-scanned projects are replaced wholesale."""
    kept = old.join(scanned_ids.select(F.col("id").alias(key)), key, "left_anti")
    return kept.unionByName(new.select(*old.columns))


def incremental_scan(catalog: DataFrame, disk: DataFrame, scan_rows: DataFrame, as_of) -> dict[str, DataFrame]:
    """M3: renames -> orphans -> changed set -> scan -> upsert.

    ``scan_rows(name, new_id, <scan columns>)`` are the scan results of the
    folders on disk (normally produced by the inventory jobs for the
    changed folders only).  Returns the new catalog and the intermediate
    sets (renames, orphans, changed) for logging.
    """
    ren = detect_renames(catalog, disk)
    orph = orphans(catalog, disk, ren)
    renamed = apply_renames(catalog, ren).join(orph.select("id"), "id", "left_anti")
    changed = changed_projects(disk, renamed)
    todo = scan_rows.join(changed.select("name", F.col("latest_mtime").alias("_m")), "name", "left_semi")
    todo = todo.withColumn("scanned_at", F.lit(as_of).cast("timestamp_ntz"))
    new_catalog = upsert(renamed, todo, as_of)
    return {"catalog": new_catalog, "renames": ren, "orphans": orph, "changed": changed, "scanned": todo}


def full_scan(catalog: DataFrame, disk: DataFrame, scan_rows: DataFrame, as_of,
              only: list[str] | None = None) -> DataFrame:
    """M4: full scan (every folder on disk re-scanned) or single-project
    scan (``only`` names); renames and orphans are applied first, as in M3."""
    ren = detect_renames(catalog, disk)
    orph = orphans(catalog, disk, ren)
    renamed = apply_renames(catalog, ren).join(orph.select("id"), "id", "left_anti")
    todo = scan_rows if not only else scan_rows.where(F.col("name").isin(only))
    todo = todo.withColumn("scanned_at", F.lit(as_of).cast("timestamp_ntz"))
    return upsert(renamed, todo, as_of)


def scan_log_row(result: dict[str, DataFrame], scan_type: str, started_at, completed_at,
                 triggered_by: str = "scheduler", errors: DataFrame | None = None) -> DataFrame:
    """The log row of one scan, counted from the scan's own outputs
    (``incremental_scan`` result): projects found = changed folders,
    projects scanned = rows written, error_count = rows of ``errors``.  The
    errors themselves are stored as rows, all of them."""
    spark = result["changed"].sparkSession
    found = result["changed"].agg(F.count(F.lit(1)).alias("projects_found"))
    scanned = result["scanned"].agg(F.count(F.lit(1)).alias("projects_scanned"))
    errs = errors if errors is not None else spark.createDataFrame([], "error string")
    e = errs.agg(F.count(F.lit(1)).alias("error_count"))
    return (found.crossJoin(scanned).crossJoin(e)
            .select(F.lit(scan_type).alias("scan_type"), F.lit(started_at).cast("timestamp_ntz").alias("started_at"),
                    F.lit(completed_at).cast("timestamp_ntz").alias("completed_at"), "projects_found",
                    "projects_scanned", "error_count", F.lit(triggered_by).alias("triggered_by")))
