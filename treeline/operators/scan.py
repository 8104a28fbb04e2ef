"""Inventory operators over a file table.

Input rows: ``files(project, path, name, size_bytes, modified_at[, content])``
with ``path`` relative to the project root.  One row per file of every
project; the table may come from the ``repo_tree`` source or any other
listing.  Every operator is a grouped aggregation keyed by project (or by
(project, language)), so work is partitioned by project and combined
map-side before the shuffle; a project holding a third of all files only
sends its partial aggregates through the shuffle, never its files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import exprs, fixed
from treeline.operators.common import small_table


# ------------------------------------------------------------ lookup tables

def ext_language_table(spark: SparkSession) -> DataFrame:
    """(ext, language) -- 59 rows, broadcast in every join."""
    return small_table(spark, fixed.LANGUAGE_EXTENSIONS, "ext string, language string")


def grep_language_table(spark: SparkSession) -> DataFrame:
    """Deep-search language labels."""
    return small_table(spark, fixed.GREP_LANGUAGE, "ext string, language string")


def with_language(files: DataFrame) -> DataFrame:
    """Attach ``ext`` (lower-cased suffix) and ``language`` (or null)."""
    spark = files.sparkSession
    langs = F.broadcast(ext_language_table(spark).withColumnRenamed("ext", "_ext"))
    f = files.withColumn("ext", exprs.suffix(F.col("name")))
    return (f.join(langs, f["ext"] == langs["_ext"], "left").drop("_ext"))


def with_flags(files: DataFrame) -> DataFrame:
    """Attach ``excluded`` (P1), ``hidden`` (dot-file name) and ``depth``."""
    return (files
            .withColumn("excluded", exprs.path_excluded(F.col("path")))
            .withColumn("hidden", F.col("name").startswith("."))
            .withColumn("depth", exprs.depth(F.col("path"))))


# --------------------------------------------------------------- predicates

def project_test(files: DataFrame) -> DataFrame:
    """Per project, is it a project?

    True when a marker exists at the root (file or directory of that name)
    or a source file (name ends with a known suffix, case-sensitive)
    sits at depth 1 or 2.  Evaluated on the unpruned tree.
    """
    exts = [e for e, _ in fixed.LANGUAGE_EXTENSIONS]
    marker = exprs.first_segment(F.col("path")).isin(fixed.PROJECT_MARKERS)
    name = F.col("name")
    source = F.lit(False)
    for e in exts:
        source = source | name.endswith(e)
    shallow_source = (exprs.depth(F.col("path")) <= 2) & source
    return files.groupBy("project").agg(
        F.max(marker.cast("int")).cast("boolean").alias("has_marker"),
        F.max(shallow_source.cast("int")).cast("boolean").alias("has_shallow_source"),
    ).withColumn("is_project", F.col("has_marker") | F.col("has_shallow_source"))


def discover(files: DataFrame) -> DataFrame:
    """Project folders of the base directory, sorted by name.

    A folder is kept when its own name is not excluded (P1) and it passes
    the project test (P2).
    """
    t = project_test(files)
    return (t.where(F.col("is_project") & ~exprs.dir_excluded(F.col("project")))
            .select("project", "has_marker", "has_shallow_source"))


def inventory(files: DataFrame) -> DataFrame:
    """Catalogued files -- pruned (P1), dot-files skipped, with language."""
    f = with_flags(files).where(~F.col("excluded") & ~F.col("hidden"))
    return with_language(f).select("project", "path", "name", "size_bytes", "modified_at", "language")


# ------------------------------------------------------------- aggregations

def _line_count(files: DataFrame):
    """The lines of a file: a column ``lines`` where they were counted before, else from ``content``."""
    return F.col("lines") if "lines" in files.columns else exprs.line_count(F.col("content"))


def project_stats(files: DataFrame) -> DataFrame:
    """A1: file_count (dot-files included), size_bytes, lines_of_code over
    known-language files, on the pruned tree.  Needs ``content`` or ``lines``."""
    f = with_language(with_flags(files).where(~F.col("excluded")))
    loc = F.when(F.col("language").isNotNull(), _line_count(files)).otherwise(F.lit(0))
    return f.groupBy("project").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum("size_bytes").cast("long").alias("size_bytes"),
        F.sum(loc).cast("long").alias("lines_of_code"),
    )


def language_loc(files: DataFrame) -> DataFrame:
    """Per (project, language) lines of code, pruned tree, known languages only."""
    f = with_language(with_flags(files).where(~F.col("excluded"))).where(F.col("language").isNotNull())
    return f.groupBy("project", "language").agg(F.sum(_line_count(files)).cast("long").alias("loc"))


def languages(files: DataFrame) -> DataFrame:
    """A2: languages ranked by LOC desc (ties by name); primary = first."""
    per = language_loc(files)
    ranked = per.groupBy("project").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("loc")).alias("k"), F.col("language").alias("language")))).alias("r"))
    return ranked.select(
        "project",
        F.transform("r", lambda x: x["language"]).alias("languages"),
        F.element_at(F.col("r"), 1)["language"].alias("primary_language"),
    )


def project_dates(files: DataFrame) -> DataFrame:
    """A3: earliest mtime over catalogued files; latest mtime over code files
    (known language or a config suffix), generated docs excluded."""
    f = with_language(with_flags(files).where(~F.col("excluded") & ~F.col("hidden")))
    code = (~F.col("name").isin(fixed.GENERATED_FILES)) & (
        F.col("language").isNotNull() | F.col("ext").isin(fixed.CODE_DATE_EXTRA_EXTENSIONS))
    return f.groupBy("project").agg(
        F.min("modified_at").alias("project_created_at"),
        F.max(F.when(code, F.col("modified_at"))).alias("last_code_modified_at"),
    )


def latest_mtime(files: DataFrame) -> DataFrame:
    """A4: latest mtime used by change detection: pruned, non-hidden files
    other than the three generated documents.  Projects without such a
    file get no row."""
    f = with_flags(files).where(~F.col("excluded") & ~F.col("hidden") & ~F.col("name").isin(fixed.CHANGE_IGNORED_FILES))
    return f.groupBy("project").agg(F.max("modified_at").alias("latest_mtime"))


# ---------------------------------------------------------------- listings

def directory_listings(inventory_df: DataFrame) -> DataFrame:
    """O8 batch form: the listing of every directory of every project.

    Each file contributes one row per ancestor directory: a subdirectory
    row in each proper ancestor and a file row in its own directory.
    Duplicate subdirectory rows collapse through ``distinct`` (map-side
    first).  Order within a listing (directories first, then lower(name))
    is applied when one listing is read: :func:`list_directory`.
    """
    parts = F.split(F.col("path"), "/")
    f = inventory_df.select("project", "path", "size_bytes", "modified_at", "language", parts.alias("parts"))
    f = f.select("*", F.posexplode(F.slice(F.col("parts"), 1, F.size("parts"))).alias("i", "seg"))
    n = F.size("parts")
    dir_path = F.array_join(F.slice(F.col("parts"), 1, F.col("i")), "/")
    is_dir = F.col("i") < n - 1
    child_path = F.array_join(F.slice(F.col("parts"), 1, F.col("i") + 1), "/")
    rows = f.select(
        "project",
        dir_path.alias("dir"),
        F.col("seg").alias("name"),
        child_path.alias("path"),
        is_dir.alias("is_directory"),
        F.when(is_dir, F.lit(0)).otherwise(F.col("size_bytes")).cast("long").alias("size_bytes"),
        F.when(~is_dir, F.col("modified_at")).alias("modified_at"),
        F.when(~is_dir, F.col("language")).alias("language"),
    )
    return rows.distinct()


def list_directory(listings: DataFrame, project: str, dir_path: str = "") -> DataFrame:
    """O8 single listing, directories first then by lower-cased name."""
    d = dir_path.rstrip("/")
    return (listings.where((F.col("project") == project) & (F.col("dir") == d))
            .orderBy(F.desc("is_directory"), F.lower("name"), F.asc("name")))


def lines(files: DataFrame, drop_binary: bool = True) -> DataFrame:
    """S3: (project, path, line_no, line) -- 1-based line numbers.

    Universal newlines; a file whose content holds a NUL byte is binary
    and skipped (grep -I).  Content never crosses a shuffle: the explode
    runs in the scan's own tasks.
    """
    f = files
    if drop_binary:
        f = f.where(~F.col("content").contains("\u0000"))
    norm = F.regexp_replace(F.col("content"), "\r\n?", "\n")
    pieces = F.split(norm, "\n", -1)
    # a trailing terminator does not open a new line
    pieces = F.when(exprs.ends_with_newline(F.col("content")), F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    pieces = F.when(F.col("content") == "", F.array().cast("array<string>")).otherwise(pieces)
    return (f.select("project", "path", F.posexplode(pieces).alias("i", "line"))
            .select("project", "path", (F.col("i") + 1).cast("int").alias("line_no"), "line"))
