"""Registered catalog-maintenance queries (J5-J7, J9, M1-M3, M5) over the
``customer`` before/after binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.io import table
from treeline.operators import catalog as cat
from treeline.operators import history, scan
from treeline.plans.registry import register
from treeline.plans.scan_queries import _FLAGGED, _IGNORED
from treeline.plans.standins import (CATALOG_SQL, MODULES_SQL, SNAPSHOTS_SQL, catalog_before, disk_after, file_tree,
                                     loc_snapshots, modules)

AS_OF = "2025-01-01 00:00:00"
W = "WITH " + CATALOG_SQL


@register("j5_renames", W + "\nSELECT id, old_name, new_name, remote FROM renames")
def j5_renames(spark, sf_dir):
    return cat.detect_renames(catalog_before(spark, sf_dir), disk_after(spark, sf_dir)).select(
        "id", "old_name", "new_name", "remote")


@register("m5_apply_renames", W + "\nSELECT id, name, path FROM renamed")
def m5_apply_renames(spark, sf_dir):
    c, d = catalog_before(spark, sf_dir), disk_after(spark, sf_dir)
    ren = cat.detect_renames(c, d)
    out = cat.apply_renames(c, ren).join(cat.orphans(c, d, ren).select("id"), "id", "left_anti")
    return out.select("id", "name", "path")


@register("j6_changed", W + """,
ch0 AS (
  SELECT d.name, d.path, d.latest_mtime, b.scanned_at, b.id IS NULL AS is_new
  FROM disk d LEFT JOIN before b ON d.name = b.name
  WHERE d.latest_mtime IS NOT NULL AND (b.scanned_at IS NULL OR d.latest_mtime > b.scanned_at))
SELECT * FROM ch0""")
def j6_changed(spark, sf_dir):
    return cat.changed_projects(disk_after(spark, sf_dir), catalog_before(spark, sf_dir))


@register("j9_changed_view", W + "\nSELECT name, path, latest_mtime AS last_modified, scanned_at, is_new FROM changed")
def j9_changed_view(spark, sf_dir):
    c, d = catalog_before(spark, sf_dir), disk_after(spark, sf_dir)
    ren = cat.detect_renames(c, d)
    renamed = cat.apply_renames(c, ren).join(cat.orphans(c, d, ren).select("id"), "id", "left_anti")
    ch = cat.changed_projects(d, renamed)
    return ch.select("name", "path", F.col("latest_mtime").alias("last_modified"), "scanned_at", "is_new")


@register("j7_orphans", W + ",\n" + MODULES_SQL + """
SELECT o.id, o.name, count(m.module_id)::BIGINT AS removed_modules
FROM orphans o LEFT JOIN mods m ON m.project_id = o.id GROUP BY o.id, o.name""")
def j7_orphans(spark, sf_dir):
    c, d = catalog_before(spark, sf_dir), disk_after(spark, sf_dir)
    orph = cat.orphans(c, d, cat.detect_renames(c, d)).select("id", "name")
    m = modules(spark, sf_dir)
    gone = m.join(orph.select(F.col("id").alias("project_id")), "project_id", "left_semi")
    counts = gone.groupBy(F.col("project_id").alias("id")).agg(F.count(F.lit(1)).alias("removed_modules"))
    return (orph.join(counts, "id", "left")
            .select("id", "name", F.coalesce("removed_modules", F.lit(0)).cast("long").alias("removed_modules")))


@register("m1_upsert", W + f""",
up AS (
  SELECT coalesce(b.id, d.new_id) AS id, coalesce(d.name, b.name) AS name,
         CASE WHEN d.name IS NOT NULL THEN d.path ELSE b.path END AS path,
         CASE WHEN d.name IS NOT NULL THEN d.lines_of_code ELSE b.lines_of_code END AS lines_of_code,
         b.scanned_at,
         CASE WHEN d.name IS NOT NULL THEN TIMESTAMP '{AS_OF}' END AS updated_at
  FROM before b FULL OUTER JOIN (SELECT new_id, name, path, lines_of_code FROM disk) d ON b.name = d.name)
SELECT * FROM up""")
def m1_upsert(spark, sf_dir):
    scanned = disk_after(spark, sf_dir).select("new_id", "name", "path", "lines_of_code")
    out = cat.upsert(catalog_before(spark, sf_dir), scanned, AS_OF)
    return out.select("id", "name", "path", "lines_of_code", "scanned_at", "updated_at")


@register("m2_replace_children", W + ",\n" + MODULES_SQL + """,
scanned AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0),
newm AS (SELECT module_id, project_id, name || '-v2' AS name, path, description FROM mods
         WHERE project_id IN (SELECT id FROM scanned))
SELECT module_id, project_id, name FROM mods
WHERE project_id NOT IN (SELECT id FROM scanned)
UNION ALL SELECT module_id, project_id, name FROM newm""")
def m2_replace_children(spark, sf_dir):
    old = m = modules(spark, sf_dir)
    scanned = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).where("id % 2 = 0")
    new = (m.join(scanned.select(F.col("id").alias("project_id")), "project_id", "left_semi")
           .withColumn("name", F.concat(F.col("name"), F.lit("-v2"))))
    return cat.replace_children(old, new, scanned).select("module_id", "project_id", "name")


@register("m3_incremental", W + f""",
todo AS (SELECT d.new_id, d.name, d.path, d.lines_of_code FROM disk d WHERE d.name IN (SELECT name FROM changed)),
up AS (
  SELECT coalesce(r.id, t.new_id) AS id, coalesce(t.name, r.name) AS name,
         CASE WHEN t.name IS NOT NULL THEN t.path ELSE r.path END AS path,
         CASE WHEN t.name IS NOT NULL THEN t.lines_of_code ELSE r.lines_of_code END AS lines_of_code,
         CASE WHEN t.name IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE r.scanned_at END AS scanned_at,
         r.git_remote_url
  FROM renamed r FULL OUTER JOIN todo t ON r.name = t.name)
SELECT * FROM up""")
def m3_incremental(spark, sf_dir):
    d = disk_after(spark, sf_dir)
    scan_rows = d.select("new_id", "name", "path", "lines_of_code")
    res = cat.incremental_scan(catalog_before(spark, sf_dir), d, scan_rows, AS_OF)
    return res["catalog"].select("id", "name", "path", "lines_of_code", "scanned_at", "git_remote_url")


# ------------------------------------------------- the other tables of a scan

@register("j6_changed_from_files", "WITH " + _FLAGGED + """,
mt AS (SELECT project, max(modified_at) AS latest_mtime FROM flagged
       WHERE NOT excluded AND NOT hidden AND name NOT IN (""" + _IGNORED + """) GROUP BY project),
known AS (SELECT DISTINCT source AS name, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(regexp_extract(source, '([0-9]+)', 1)::BIGINT * 50) AS scanned_at
          FROM documents WHERE regexp_extract(source, '([0-9]+)', 1)::INTEGER % 4 <> 0)
SELECT mt.project AS name, mt.latest_mtime, k.scanned_at, k.name IS NULL AS is_new FROM mt LEFT JOIN known k ON mt.project = k.name
WHERE k.scanned_at IS NULL OR mt.latest_mtime > k.scanned_at""")
def j6_changed_from_files(spark, sf_dir):
    """J6 fed by A4: change times come from the files themselves."""
    files = file_tree(spark, sf_dir, with_content=False)
    disk = scan.latest_mtime(files).select(F.col("project").alias("name"), F.concat(F.lit("/code/"), "project").alias("path"), "latest_mtime")
    n = F.regexp_extract("name", "([0-9]+)", 1).cast("int")
    known = files.select(F.col("project").alias("name")).distinct().where(n % 4 != 0).select(
        "name", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), n * 50)).alias("scanned_at"))
    return cat.changed_projects(disk, known).select("name", "latest_mtime", "scanned_at", "is_new")


@register("j7_cascade", W + ",\n" + MODULES_SQL + ",\n" + SNAPSHOTS_SQL + """,
left_over AS (SELECT id FROM renamed)
SELECT 'module' AS child, project_id, count(*)::BIGINT AS n FROM mods WHERE project_id IN (SELECT id FROM left_over) GROUP BY 2
UNION ALL SELECT 'history', project_id, count(*)::BIGINT FROM snaps WHERE project_id IN (SELECT id FROM left_over) GROUP BY 2
UNION ALL SELECT 'vector', vec_id, 1::BIGINT FROM embeddings WHERE vec_id IN (SELECT id FROM left_over)""")
def j7_cascade(spark, sf_dir):
    """Children of every kind that survive a scan (modules, LOC history, vectors)."""
    c, d = catalog_before(spark, sf_dir), disk_after(spark, sf_dir)
    ren = cat.detect_renames(c, d)
    alive = c.join(cat.orphans(c, d, ren).select("id"), "id", "left_anti").select("id")
    kinds = {"module": modules(spark, sf_dir), "history": loc_snapshots(spark, sf_dir),
             "vector": table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("project_id"))}
    parts = [cat.cascade(t, alive).groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("child"), "project_id", "n")
             for k, t in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("m4_full_scan", W + f""",
up AS (
  SELECT coalesce(r.id, t.new_id) AS id, coalesce(t.name, r.name) AS name,
         CASE WHEN t.name IS NOT NULL THEN t.lines_of_code ELSE r.lines_of_code END AS lines_of_code,
         CASE WHEN t.name IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE r.scanned_at END AS scanned_at
  FROM renamed r FULL OUTER JOIN disk t ON r.name = t.name)
SELECT * FROM up""")
def m4_full_scan(spark, sf_dir):
    d = disk_after(spark, sf_dir)
    out = cat.full_scan(catalog_before(spark, sf_dir), d, d.select("new_id", "name", "path", "lines_of_code"), AS_OF)
    return out.select("id", "name", "lines_of_code", "scanned_at")


@register("m6_append_history", "WITH " + SNAPSHOTS_SQL + f""",
last AS (SELECT project_id, arg_max(lines_of_code, (recorded_at, snapshot_id)) AS loc FROM snaps GROUP BY 1),
cur AS (SELECT c_custkey AS project_id, floor(c_acctbal * 100)::BIGINT AS lines_of_code FROM customer
        UNION ALL SELECT -project_id, loc FROM last
        UNION ALL SELECT project_id, loc FROM last WHERE project_id NOT IN (SELECT c_custkey FROM customer))
SELECT c.project_id, c.lines_of_code, TIMESTAMP '{AS_OF}' AS recorded_at FROM cur c LEFT JOIN last l ON c.project_id = l.project_id
WHERE l.project_id IS NULL OR l.loc IS DISTINCT FROM c.lines_of_code""")
def m6_append_history(spark, sf_dir):
    """M6: history rows of a scan: new projects and changed sizes only."""
    h = loc_snapshots(spark, sf_dir)
    last = h.groupBy("project_id").agg(F.max_by("lines_of_code", F.struct("recorded_at", "snapshot_id")).alias("lines_of_code"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.floor(F.col("c_acctbal") * 100).cast("long").alias("lines_of_code"))
    cur = (c.unionByName(last.select((-F.col("project_id")).alias("project_id"), "lines_of_code"))
           .unionByName(last.join(c.select("project_id"), "project_id", "left_anti")))
    return history.append_on_change(h, cur, AS_OF).select("project_id", "lines_of_code", "recorded_at")
