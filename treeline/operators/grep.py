"""In-file regex search with context.

A search is one pass over the text: files are filtered by name (P4 include
globs), binaries dropped, and each file's content is split into an array of
lines once.  The positions of matching lines, the neighbouring matches and
the context are all taken from that array inside the scan's own tasks, and
the finished match rows are exploded.  No line is shuffled or joined; a limit
is a top-k over match rows.  Work per row is bounded by one file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import exprs, fixed
from treeline.operators import scan

_POSIX_CLASSES = {
    "[:alpha:]": r"\p{Alpha}", "[:digit:]": r"\d", "[:alnum:]": r"\p{Alnum}", "[:upper:]": r"\p{Upper}",
    "[:lower:]": r"\p{Lower}", "[:space:]": r"\s", "[:punct:]": r"\p{Punct}", "[:xdigit:]": r"\p{XDigit}",
    "[:blank:]": r"[ \t]", "[:cntrl:]": r"\p{Cntrl}", "[:print:]": r"\p{Print}", "[:graph:]": r"\p{Graph}",
}


def _bracket_body(body: str) -> str:
    """Inside of a bracket expression: a backslash, ``[`` and ``&`` are
    literal in POSIX but special in Java; POSIX classes are kept."""
    out, i = ["^"] if body.startswith("^") else [], int(body.startswith("^"))
    if body[i:i + 1] == "]":
        out.append(r"\]")
        i += 1
    while i < len(body):
        end = body.find(":]", i + 2) + 2 if body.startswith("[:", i) else 1
        if end > 1 and body[i:end] in _POSIX_CLASSES:
            out.append(_POSIX_CLASSES[body[i:end]])
            i = end
        else:
            out.append("\\" + body[i] if body[i] in "\\[&^" else body[i])
            i += 1
    return "".join(out)


def bre_to_java(q: str) -> str:
    """Translate a POSIX basic regular expression (GNU flavour) to Java.

    In a BRE ``+ ? | ( ) { }`` are literals and their backslashed forms are
    operators; ``*`` at the start of an expression is literal; ``\\<`` and
    ``\\>`` are word boundaries.  Bracket expressions are copied with POSIX
    classes rewritten.
    """
    out: list[str] = []
    i, n = 0, len(q)
    at_start = True
    while i < n:
        c = q[i]
        if c == "\\" and i + 1 < n:
            d = q[i + 1]
            if d in "+?|(){}":
                out.append(d)
                at_start = d in "(|"
            elif d in "<>":
                out.append(r"\b")
                at_start = False
            else:
                out.append("\\" + d)
                at_start = False
            i += 2
            continue
        if c == "[":
            j = i + 1
            if j < n and q[j] == "^":
                j += 1
            if j < n and q[j] == "]":
                j += 1
            while j < n and q[j] != "]":
                if q[j] == "[" and j + 1 < n and q[j + 1] == ":":
                    k = q.find(":]", j + 2)
                    j = k + 2 if k >= 0 else j + 1
                else:
                    j += 1
            out.append("[" + _bracket_body(q[i + 1:j]) + "]")
            i = j + 1
            at_start = False
            continue
        if c in "+?|(){}":
            out.append("\\" + c)
        elif c == "*" and at_start:
            out.append(r"\*")
        elif c == "^" and not at_start:
            out.append(r"\^")
        elif c == "$" and i != n - 1 and q[i + 1:i + 3] not in (r"\)", r"\|"):
            out.append(r"\$")
        else:
            out.append(c)
        at_start = c == "^" and at_start
        i += 1
    return "".join(out)


def grep_files(files: DataFrame, apply_exclude: bool = True) -> DataFrame:
    """Files the deep search reads: include globs (case-sensitive),
    no binaries; the exclusion list (P1) applies unless switched off."""
    name = F.col("name")
    inc = F.lit(False)
    for g in fixed.GREP_INCLUDE:
        inc = inc | name.endswith(g.lstrip("*"))
    f = files.where(inc & ~F.col("content").contains("\u0000"))
    if apply_exclude:
        f = f.where(~exprs.path_excluded(F.col("path")))
    return f


def with_grep_language(df: DataFrame) -> DataFrame:
    """Attach the deep-search language label by lower-cased suffix (P4 map)."""
    langs = F.broadcast(scan.grep_language_table(df.sparkSession).withColumnRenamed("language", "glang"))
    d = df.withColumn("_ext", exprs.suffix(exprs.basename(F.col("path"))))
    return d.join(langs, d["_ext"] == langs["ext"], "left").drop("_ext", "ext").withColumnRenamed("glang", "language")


def _normalized(files: DataFrame, newline: str = "universal") -> DataFrame:
    """(project, path, content_n) with line ends mapped to '\n' once.

    ``universal``: '\r\n', '\r' and '\n' end lines (Python text mode).
    ``lf``: only '\n' ends a line, as grep numbers them; a '\r' before it
    is dropped and text after a lone '\r' is cut from the line, which is
    what the reference's text-mode reading of grep output shows.
    """
    c = F.col("content")
    if newline == "lf":
        c = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\r[^\n]*", "")
    else:
        c = F.regexp_replace(c, "\r\n?", "\n")
    return files.select("project", "path", c.alias("content_n"))


def _with_lines(norm: DataFrame) -> DataFrame:
    """project, path, lines: the lines of normalised content (a trailing newline opens no line)."""
    c = F.col("content_n")
    pieces = F.split(c, "\n", -1)
    pieces = F.when(c == "", F.array().cast("array<string>")).when(
        F.substring(c, -1, 1) == "\n", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    return norm.select("project", "path", pieces.alias("lines"))


def _hits(lines: Column, java_regex: str) -> Column:
    """Numbers (from 1) of the matching lines."""
    n = F.transform(lines, lambda x, i: F.when(x.rlike(java_regex), i + 1))
    return F.filter(n, lambda i: i.isNotNull())


def file_hits(files: DataFrame, java_regex: str, newline: str = "universal") -> DataFrame:
    """project, path, lines, hits of every file with a match; files that
    match nowhere (multi-line mode) are dropped before they are split."""
    norm = _normalized(files, newline).where(F.col("content_n").rlike("(?m)" + java_regex))
    return _with_lines(norm).withColumn("hits", _hits(F.col("lines"), java_regex)).where(F.size("hits") > 0)


def _match(lines: Column, hits: Column, k: Column, context: int, mode: str) -> Column:
    """The k-th hit (from 0) as a struct with its context lines."""
    at, n = F.get(hits, k), F.size(lines)
    first, last = F.greatest(at - context, F.lit(1)), F.least(at + context, n)
    if mode == "reference":
        before, after = F.get(hits, k - 1), F.get(hits, k + 1)
        last = F.when(after.isNull(), last).otherwise(F.least(last, after - 1))
        first = F.when(before.isNull() | (at - before > 2 * context + 1), first).otherwise(at)
    return F.struct(at.alias("line_no"), F.get(lines, at - 1).alias("line"),
                    F.slice(lines, first, at - first).alias("before"),
                    F.slice(lines, at + 1, F.greatest(last - at, F.lit(0))).alias("after"))


def search(files: DataFrame, pattern: str, context: int = 2, limit: int | None = 100, mode: str = "reference",
           syntax: str = "bre", apply_exclude: bool = True, newline: str = "universal") -> DataFrame:
    """Matching lines with ``before`` / ``after`` context arrays.

    ``mode='reference'``: matches closer than 2C+2 lines form one group; a
    later match in a group has no leading context and a match's trailing
    context stops before the next match.  ``mode='full'``: plain +-C window.
    ``limit`` keeps the first matches by (project, path, line_no), exactly;
    neither it nor ``context`` has a cap here (:func:`check_request` is for
    callers that serve requests).
    Output: project, path, line_no, line, before, after, language.
    """
    if context < 0 or (limit is not None and limit < 0):
        raise ValueError("context and limit must not be negative")
    rx = bre_to_java(pattern) if syntax == "bre" else pattern
    found = file_hits(grep_files(files, apply_exclude), rx, newline)
    each = F.transform(F.sequence(F.lit(0), F.size("hits") - 1),
                       lambda k: _match(F.col("lines"), F.col("hits"), k, context, mode))
    out = found.select("project", "path", F.explode(each).alias("m")).select("project", "path", "m.*")
    if limit is not None:
        out = out.orderBy("project", "path", "line_no").limit(limit)
    return with_grep_language(out)


def check_request(limit: int = 100, context: int = 2) -> None:
    """The bounds of a search request; a request beyond them is refused, never cut."""
    if not 0 < limit <= fixed.GREP_MAX_LIMIT:
        raise ValueError(f"limit must be 1 to {fixed.GREP_MAX_LIMIT}")
    if not 0 <= context <= fixed.GREP_MAX_CONTEXT:
        raise ValueError(f"context must be 0 to {fixed.GREP_MAX_CONTEXT}")


def match_counts(files: DataFrame, java_regex: str, newline: str = "universal") -> DataFrame:
    """A13 input: project, path, n_matches, without building match rows."""
    return file_hits(files, java_regex, newline).select("project", "path", F.size("hits").cast("long").alias("n_matches"))


def matches_by_file(counts: DataFrame) -> DataFrame:
    """Matches per file and the overall total.  ``counts``: project,
    path, n_matches rows (several for one file add up); both results come
    from the same small aggregate."""
    per = counts.groupBy("project", "path").agg(F.sum("n_matches").alias("n_matches"))
    total = per.agg(F.sum("n_matches").alias("total_matches"))
    return per.crossJoin(F.broadcast(total))


def viewable(files: DataFrame, max_bytes: int = fixed.VIEWABLE_MAX_BYTES) -> DataFrame:
    """P13 + A15: size guard for the file viewer and the viewer's line count."""
    ok = F.col("size_bytes") <= max_bytes
    return files.select(
        "project", "path", "size_bytes", ok.alias("viewable"),
        F.when(~ok, F.lit("File too large to display")).alias("reason"),
        F.when(ok, exprs.view_line_count(F.col("content"))).alias("view_lines"),
    )


_RANGE_RX = re.compile(r"^\s*(\d+)\s*(?:-\s*(\d+))?\s*$")


def parse_line_spec(spec: str | None) -> tuple[int, int] | None:
    """``line=n`` or ``lines=a-b`` (inclusive); a bad spec is ignored."""
    if not spec:
        return None
    m = _RANGE_RX.match(spec)
    if not m:
        return None
    a = int(m.group(1))
    b = int(m.group(2)) if m.group(2) else a
    return (a, b) if a <= b else None


def line_ranges(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Slices of many files at once.

    ``files(project, path, content)``, ``requests(request_id, project, path,
    line_from, line_to)``.  Requests meet files by path and the slice is cut
    out of the file's own line array, so no line is ever shuffled; an open
    end stops at the file's length.  Requests with from > to, from < 1 or
    missing bounds select nothing.
    """
    r = requests.where((F.col("line_from") <= F.col("line_to")) & (F.col("line_from") >= 1))
    j = _with_lines(_normalized(files)).join(r, ["project", "path"])
    want = F.slice("lines", F.col("line_from").cast("int"),
                   F.least(F.col("line_to"), F.size("lines")).cast("int") - F.col("line_from").cast("int") + 1)
    j = j.where(F.col("line_from") <= F.size("lines"))
    return j.select("request_id", "project", "path", "line_from", F.posexplode(want).alias("i", "line")).select(
        "request_id", "project", "path", (F.col("line_from") + F.col("i")).cast("int").alias("line_no"), "line")
