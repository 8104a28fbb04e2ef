"""Exported git data: commit-log lines (S8) and repository identity.

Git objects are not read by the engine; a repository's history enters as
the text of ``git log --format=%H%x1f%h%x1f%an%x1f%cI%x1f%s`` (one line per
commit, U+001F between fields), its identity as (remote URL, branch).
Both are plain text sources (``spark.read.text`` over exported files) and
are parsed with built-in column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import exprs

SEP = "\u001f"

_ISO = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"


def iso_to_utc_ntz(s: Column) -> Column:
    """ISO-8601 text with offset (or Z) -> naive UTC timestamp; bad -> null.

    The wall-clock part is parsed without a zone and the offset subtracted
    explicitly, so the result does not depend on the session time zone.
    A value without offset is taken as UTC.
    """
    t = F.trim(s)
    ok = t.rlike(_ISO)
    local = F.concat(F.regexp_extract(t, _ISO, 1), F.lit(" "), F.regexp_extract(t, _ISO, 2))
    ntz = F.try_to_timestamp(local, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    off = F.regexp_extract(t, _ISO, 4)
    sign = F.when(off.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    digits = F.regexp_replace(off, "[^0-9]", "")
    hh = F.when(F.length(digits) == 4, F.substring(digits, 1, 2).cast("int")).otherwise(F.lit(0))
    mm = F.when(F.length(digits) == 4, F.substring(digits, 3, 2).cast("int")).otherwise(F.lit(0))
    frac = F.regexp_extract(t, _ISO, 3)
    micros = F.when(frac != "", F.rpad(F.substring(frac, 2, 6), 6, "0").cast("int")).otherwise(F.lit(0))
    shifted = ntz - F.make_dt_interval(F.lit(0), sign * hh, sign * mm, micros / F.lit(1_000_000.0))
    return F.when(ok, shifted)


def parse_commit_lines(lines: DataFrame, line_col: str = "value", project_col: str = "project",
                       keep: list[str] | None = None) -> DataFrame:
    """Commit records from exported log lines.

    Blank lines and lines without exactly five fields are skipped; an empty
    author becomes null; an unreadable date becomes null.
    Output: project, sha, short_sha, author, committed_at, message.
    """
    parts = F.split(F.col(line_col), SEP, -1)
    keep = keep or []
    d = lines.where(F.trim(F.col(line_col)) != "").select(F.col(project_col).alias("project"), parts.alias("p"), *keep)
    d = d.where(F.size("p") == 5)
    return d.select(
        "project", *keep,
        F.col("p")[0].alias("sha"),
        F.col("p")[1].alias("short_sha"),
        F.nullif(F.col("p")[2], F.lit("")).alias("author"),
        iso_to_utc_ntz(F.col("p")[3]).alias("committed_at"),
        F.col("p")[4].alias("message"),
    )


def read_commit_logs(spark: SparkSession, path: str) -> DataFrame:
    """Exported logs laid out as ``<root>/<project>/commits.log``."""
    raw = spark.read.text(path)
    return raw.withColumn("project", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def repo_identity(remotes: DataFrame, remote_col: str = "remote_url", branch_col: str | None = "branch") -> DataFrame:
    """is_repo, remote URL, default branch and derived GitHub name."""
    r = F.trim(F.col(remote_col))
    cols = [c for c in remotes.columns if c not in (remote_col, branch_col)]
    return remotes.select(
        *cols,
        r.alias("remote_url"),
        (F.col(branch_col) if branch_col else F.lit(None).cast("string")).alias("default_branch"),
        exprs.github_name(r).alias("github_name"),
        r.isNotNull().alias("is_repo"),
    )
