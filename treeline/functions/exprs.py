"""Column expressions (F1-F12) used by the operators.

All are built-in Spark expressions: they run inside whole-stage codegen
and need no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeline.functions import fixed
from treeline.operators.common import glob_to_regex


def line_count(text: Column) -> Column:
    """lines of a text read with universal newlines (\\n, \\r\\n, \\r);
    a last line without terminator counts, an empty text has 0 lines."""
    t = F.coalesce(text, F.lit(""))
    terminators = F.size(F.split(t, "\r\n|\r|\n", -1)) - 1
    open_tail = F.when((t != "") & ~ends_with_newline(t), 1).otherwise(0)
    return (terminators + open_tail).cast("long")


def ends_with_newline(t: Column) -> Column:
    """Last character is CR or LF."""
    return F.substring(t, -1, 1).isin("\r", "\n")


def view_line_count(text: Column) -> Column:
    """Number of pieces of ``text.split('\\n')`` (a trailing newline adds 1)."""
    return F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).cast("long")


def suffix(name: Column) -> Column:
    """lower-cased final suffix of a file name ('' when none)."""
    return F.lower(F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def depth(path: Column) -> Column:
    """Number of path components (a root-level file has depth 1)."""
    return F.size(F.split(path, "/"))


def first_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), 1)


def parent_dirs(path: Column) -> Column:
    """Directory components of a relative file path (file name dropped)."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def excluded_dir_regex(patterns: list[str] | None = None) -> str:
    """P1 as one anchored regex: a glob from the list, or a dot-name."""
    pats = patterns if patterns is not None else fixed.EXCLUDE_DIRS
    return "^(?:" + "|".join(glob_to_regex(p) for p in pats) + r"|\..*)$"


def path_excluded(path: Column, patterns: list[str] | None = None) -> Column:
    """Some directory component of the path is excluded."""
    rx = excluded_dir_regex(patterns)
    return F.exists(parent_dirs(path), lambda c: c.rlike(rx))


def dir_excluded(name: Column, patterns: list[str] | None = None) -> Column:
    """P1 applied to one directory name."""
    return name.rlike(excluded_dir_regex(patterns))


def github_name(remote: Column) -> Column:
    """``owner/repo`` of a GitHub remote, else null.

    SSH form (``git@host:owner/repo.git``): the piece after the first colon;
    HTTPS form: the piece after ``github.com/``.  Only a trailing ``.git``
    is removed (an inner ``.git`` as in ``u/my.github.io`` is kept).
    """
    r = F.trim(remote)
    ssh = F.try_element_at(F.split(r, ":"), F.lit(2))
    https = F.when(r.contains("github.com/"), F.try_element_at(F.split(r, r"github\.com/"), F.lit(2)))
    raw = F.when(r.startswith("git@"), ssh).otherwise(https)
    cleaned = F.regexp_replace(raw, r"\.git$", "")
    return F.when(r.contains("github.com") & (cleaned != ""), cleaned)


def github_url(name: Column) -> Column:
    return F.when(name.isNotNull(), F.concat(F.lit("https://github.com/"), name))


def ellipsize(c: Column, n: int) -> Column:
    """F8 display form: longer than ``n`` -> first ``n-3`` + '...'."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def size_text(b: Column) -> Column:
    """human size: whole bytes, else one decimal of KB / MB / GB / TB."""
    x = b.cast("double")
    out = F.when(x < 1024, F.concat(F.format_string("%.0f", x), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(x < 1024 ** (k + 1), F.concat(F.format_string("%.1f", F.bround(x / 1024 ** k, 1)), F.lit(" " + unit)))
    return out.otherwise(F.concat(F.format_string("%.1f", F.bround(x / 1024 ** 4, 1)), F.lit(" TB")))


#: The names of time units and how many of each make the next.
AGE_UNITS = (("second", 60), ("minute", 60), ("hour", 24), ("day", 7), ("week", 4.345), ("month", 12))


def relative_age(ts: Column, as_of: Column) -> Column:
    """'just now', '45 seconds ago', ..., '2 years ago' before an
    explicit reference time; a later time is 'just now', null is ''."""
    left = F.greatest(F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp")), F.lit(0)) / 1e6
    out = F.when(ts.isNull(), F.lit(""))
    for name, size in (*AGE_UNITS, ("year", None)):
        n = F.floor(left).cast("long")
        text = F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n != 1, F.lit("s")).otherwise(F.lit("")), F.lit(" ago"))
        if size is None:
            return out.otherwise(text)
        out = out.when(left < size, F.when(n == 0, F.lit("just now")).otherwise(text))
        left = left / size


def percent(x: Column, n: Column) -> Column:
    """progress percent, one decimal, denominator at least 1."""
    return F.round(F.lit(100.0) * x / F.greatest(n, F.lit(1)), 1)


def normalize_keywords(arr: Column) -> Column:
    """Lower + trim, empties dropped, duplicates removed (first kept)."""
    return F.array_distinct(F.filter(F.transform(arr, lambda k: F.trim(F.lower(k))), lambda k: k != ""))


def to_json_string_array(arr: Column) -> Column:
    """encode an array of strings as JSON; null -> []."""
    return F.coalesce(F.to_json(arr), F.lit("[]"))


def json_string_array(text: Column) -> Column:
    """decode a JSON array of strings; bad or missing -> []."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def breadcrumbs(path: Column) -> Column:
    """cumulative prefixes of a relative path: 'a/b/c' -> ['a', 'a/b', 'a/b/c']."""
    parts = F.split(path, "/")
    return F.when((path.isNull()) | (path == ""), F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def relative_to(path: Column, root: str) -> Column:
    """path relative to ``root`` (unchanged when outside it)."""
    r = root.rstrip("/") + "/"
    return F.when(path.startswith(r), F.substring(path, len(r) + 1, 1 << 30)).otherwise(path)
