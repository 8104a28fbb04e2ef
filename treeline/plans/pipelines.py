"""End-to-end catalog jobs (M3 / M4 / T1 body).

``run_scan`` chains the operators over a real tree:

    list_tree -> discovery (S1, P1, P2) -> latest mtimes (A4) -> renames /
    orphans (J5, J7) -> changed set (J6) -> one pass over the contents of the
    changed projects' files (S3, counts and errors observed) -> stats,
    languages, dates (A1-A3) -> upsert (M1), child tables replaced (M2:
    files, commits, dependencies), LOC history appended on change (M6 / W4)
    -> touched buckets written, then put in place of the old
    -> scan log row and scan errors appended (S12)

The tree is listed once, without content, and the listing is written; only
files of the projects to scan are opened.  No per-project loop: each step is
a join or an aggregation keyed by project.  Remotes and commit logs come from
exported tables because git metadata is not read by the engine.

``scan_tables`` is the part that needs no tree: it turns what a scan found
into the new tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from treeline.functions import exprs
from treeline.operators import catalog as cat
from treeline.operators import history, scan
from treeline.session import discard, materialize
from treeline.sources import manifests as man
from treeline.sources.repo_tree import list_tree, read_contents
from treeline.sources.store import CatalogStore

SCHEMAS = {
    "projects": "id long, name string, path string, git_remote_url string, scanned_at timestamp_ntz, "
                "file_count long, size_bytes long, lines_of_code long, languages array<string>, "
                "primary_language string, project_created_at timestamp_ntz, last_code_modified_at timestamp_ntz, "
                "created_at timestamp_ntz, updated_at timestamp_ntz",
    "files": "project_id long, path string, name string, size_bytes long, modified_at timestamp_ntz, language string",
    "commits": "project_id long, sha string, short_sha string, author string, committed_at timestamp_ntz, message string",
    "dependencies": "project_id long, ecosystem string, name string, dep_type string, is_dev boolean, version string",
    "loc_history": "project_id long, snapshot_id long, recorded_at timestamp_ntz, lines_of_code long, file_count long",
}
#: Buckets of the catalog's tables, by project id: a scan rewrites those of the projects it touches.
BUCKETS = 32
MANIFESTS = ("package.json", "pyproject.toml", "setup.py", "Cargo.toml", "go.mod", "Gemfile", "composer.json")


def bucket(project_id: Column) -> Column:
    return F.pmod(F.xxhash64(project_id), F.lit(BUCKETS)).cast("int")


def new_ids(base_path: str):
    """Id of a project first seen below ``base_path`` (column ``name``)."""
    return F.xxhash64(F.concat(F.lit(base_path.rstrip("/") + "/"), F.col("name")))


def measure(files: DataFrame) -> DataFrame:
    """``files`` with ``lines`` instead of ``content``."""
    return files.withColumn("lines", F.when(F.col("content").isNotNull(), exprs.line_count(F.col("content")))).drop("content")


def scan_rows(measured: DataFrame, listing: DataFrame, base_path: str) -> DataFrame:
    """Scan results per project folder: stats (A1), languages (A2), dates (A3)."""
    out = scan.project_stats(measured).join(scan.languages(measured), "project", "left").join(scan.project_dates(listing), "project", "left")
    out = out.withColumnRenamed("project", "name")
    return out.select(
        new_ids(base_path).alias("new_id"), "name", F.concat(F.lit(base_path.rstrip("/") + "/"), F.col("name")).alias("path"),
        "file_count", "size_bytes", "lines_of_code",
        F.coalesce("languages", F.array().cast("array<string>")).alias("languages"),
        "primary_language", "project_created_at", "last_code_modified_at",
    )


def scan_tables(stored: dict[str, DataFrame], renamed: DataFrame, scanned: DataFrame, inventory: DataFrame,
                commits: DataFrame | None, dependencies: DataFrame | None, as_of: str) -> dict[str, DataFrame]:
    """The catalog's tables after a scan.

    ``stored``: the tables before it.  ``renamed``: catalog rows with renames
    applied and orphans gone.  ``scanned`` (name, new_id, scan columns): the
    scanned projects.  ``inventory`` (project, file columns), ``commits``
    (project, commit columns) and ``dependencies`` (project, dependency
    columns): what they hold.  Children of scanned projects are replaced,
    those of projects that are gone are dropped.
    """
    projects = cat.upsert(renamed, scanned, as_of)
    ids = projects.join(scanned.select("name"), "name", "left_semi").select("id", F.col("name").alias("project"))
    survivors = projects.select("id")

    def children(name: str, found: DataFrame | None) -> DataFrame:
        old = cat.cascade(stored[name], survivors)
        if found is None:
            return old
        new = found.join(ids, "project").withColumnRenamed("id", "project_id")
        return cat.replace_children(old, new, ids.select("id"))

    current = projects.join(ids.select("id"), "id", "left_semi").select(F.col("id").alias("project_id"), "lines_of_code", "file_count")
    grown = history.append_on_change(stored["loc_history"], current, as_of).withColumn("snapshot_id", F.xxhash64("project_id", "recorded_at"))
    return {
        "projects": projects,
        "files": children("files", inventory),
        "commits": children("commits", commits),
        "dependencies": children("dependencies", dependencies),
        "loc_history": cat.cascade(stored["loc_history"], survivors).unionByName(grown.select(*stored["loc_history"].columns)),
    }


def touched_buckets(renamed: DataFrame, orphans: DataFrame, renames: DataFrame, scanned: DataFrame) -> list[int]:
    """Buckets of the projects that a scan scanned, renamed or dropped; at most BUCKETS numbers."""
    known = renamed.select("name", "id")
    ids = scanned.select("name", "new_id").join(known, "name", "left").select(F.coalesce("id", "new_id").alias("id"))
    ids = ids.union(orphans.select("id")).union(renames.select("id"))
    return sorted(r.b for r in ids.select(bucket(F.col("id")).alias("b")).distinct().collect())


def run_scan(spark: SparkSession, base_path: str, store: CatalogStore, as_of: str,
             remotes: DataFrame | None = None, scan_type: str = "incremental",
             only: list[str] | None = None, triggered_by: str = "api", commits: DataFrame | None = None) -> None:
    """M3 (``scan_type='incremental'``) or M4 (``'full'`` / ``'single'``).

    ``remotes`` (name, remote) and ``commits`` (project, commit columns of
    S8): exported git metadata.  Files and folders that can't be read don't
    stop a scan; they are rows of ``scan_errors``.
    """
    listing = materialize(list_tree(spark, base_path))
    files = listing.where("error is null")
    found = scan.discover(files).select(F.col("project").alias("name"))
    mt = scan.latest_mtime(files).withColumnRenamed("project", "name")
    disk = found.join(mt, "name", "left").select(
        "name", F.concat(F.lit(base_path.rstrip("/") + "/"), F.col("name")).alias("path"), "latest_mtime")
    disk = disk.withColumn("remote", F.lit(None).cast("string")) if remotes is None else disk.join(remotes.select("name", "remote"), "name", "left")
    disk = materialize(disk)

    names = set(store.tables())
    stored = {n: store.read(n).drop("bucket") if n in names else spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
    renames = materialize(cat.detect_renames(stored["projects"], disk))
    orphans = materialize(cat.orphans(stored["projects"], disk, renames))
    renamed = cat.apply_renames(stored["projects"], renames).join(orphans.select("id"), "id", "left_anti")
    if scan_type == "incremental":
        todo = cat.changed_projects(disk, renamed).select("name")
    else:
        todo = disk.select("name") if not only else disk.where(F.col("name").isin(only)).select("name")
    todo = materialize(todo)

    own = files.join(todo.withColumnRenamed("name", "project"), "project", "left_semi")
    seen = Observation("contents")
    # the one pass over contents: lines counted, errors kept, both counted on the way
    contents = measure(read_contents(own, base_path))
    contents = materialize(contents.observe(seen, F.count(F.lit(1)).alias("files"), F.count_if(F.col("error").isNotNull()).alias("errors")))
    measured = contents.where("error is null")
    rows = scan_rows(measured, own, base_path).join(disk.select("name", F.col("remote").alias("git_remote_url")), "name", "left")
    rows = materialize(rows.withColumn("scanned_at", F.lit(as_of).cast("timestamp_ntz")))
    roots = own.where(~F.col("path").contains("/") & F.col("name").isin(*MANIFESTS))
    deps = materialize(man.dependencies(read_contents(roots, base_path)))

    tables = scan_tables(stored, renamed, rows, scan.inventory(own), commits, deps, as_of)
    tables = {n: t.withColumn("bucket", bucket(F.col("id" if n == "projects" else "project_id"))) for n, t in tables.items()}
    touched = touched_buckets(renamed, orphans, renames, rows)

    errors = listing.where("error is not null").select("project", "path", "error").unionByName(contents.where("error is not null").select("project", "path", "error"))
    errors = materialize(errors.select(F.lit(as_of).cast("timestamp_ntz").alias("started_at"), "project", "path", "error"))
    log = materialize(cat.scan_log_row({"changed": todo, "scanned": rows}, scan_type, as_of, as_of, triggered_by, errors)
                      .withColumn("files_read", F.lit(seen.get["files"]).cast("long")).withColumn("file_errors", F.lit(seen.get["errors"]).cast("long")))
    store.publish(tables, touched)
    store.append("scan_logs", log)
    store.append("scan_errors", errors)
    discard(listing, disk, renames, orphans, todo, contents, rows, deps, errors, log)
