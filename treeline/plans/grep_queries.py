"""Registered in-file search queries (W2, X8, A13, P13, P14) over the
``documents``-as-file-tree binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.functions import fixed
from treeline.operators import grep
from treeline.plans.registry import register
from treeline.plans.scan_queries import _EXCLUDED
from treeline.plans.standins import TREE_SQL, file_tree

PATTERN = "the[a-z]*on"
CONTEXT = 2
LIMIT = 100

_INCLUDE = " OR ".join(f"ends_with(name, '{g.lstrip('*')}')" for g in fixed.GREP_INCLUDE)
_GLANG = ", ".join(f"('{e}', '{l}')" for e, l in fixed.GREP_LANGUAGE)

_LINES_SQL = TREE_SQL + rf""",
gf AS (SELECT * FROM tree WHERE ({_INCLUDE}) AND NOT contains(content, chr(0)) AND NOT ({_EXCLUDED})),
norm AS (
  SELECT project, path, content,
         string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) AS pieces
  FROM gf),
cut AS (
  SELECT project, path,
         CASE WHEN content = '' THEN []::VARCHAR[]
              WHEN right(content, 1) IN (chr(13), chr(10)) THEN pieces[1:len(pieces) - 1]
              ELSE pieces END AS pieces
  FROM norm),
L AS (SELECT project, path, unnest(range(1, len(pieces) + 1))::INTEGER AS line_no, unnest(pieces) AS line FROM cut),
M AS (SELECT project, path, line_no, line,
             lag(line_no) OVER (PARTITION BY project, path ORDER BY line_no) AS prev_ln,
             lead(line_no) OVER (PARTITION BY project, path ORDER BY line_no) AS next_ln
      FROM L WHERE regexp_matches(line, '{PATTERN}')),
glang AS (SELECT * FROM (VALUES {_GLANG}) AS g(gext, language))"""


def _ctx_sql(source: str, reference: bool) -> str:
    c = CONTEXT
    want_before = f"AND (T.prev_ln IS NULL OR T.line_no - T.prev_ln > {2 * c + 1})" if reference else ""
    a_hi = (f"CASE WHEN T.next_ln IS NULL THEN T.line_no + {c} ELSE least(T.line_no + {c}, T.next_ln - 1) END"
            if reference else f"T.line_no + {c}")
    return f""",
R AS (
  SELECT T.project, T.path, T.line_no AS match_ln, 'b' AS side, L.line_no AS ln, L.line
  FROM {source} T JOIN L ON L.project = T.project AND L.path = T.path
   AND L.line_no BETWEEN greatest(T.line_no - {c}, 1) AND T.line_no - 1 {want_before}
  UNION ALL
  SELECT T.project, T.path, T.line_no, 'a', L.line_no, L.line
  FROM {source} T JOIN L ON L.project = T.project AND L.path = T.path
   AND L.line_no BETWEEN T.line_no + 1 AND {a_hi}),
C AS (
  SELECT project, path, match_ln,
         array_to_string(list(line ORDER BY ln) FILTER (WHERE side = 'b'), chr(10)) AS before,
         array_to_string(list(line ORDER BY ln) FILTER (WHERE side = 'a'), chr(10)) AS after
  FROM R GROUP BY project, path, match_ln)
SELECT T.project, T.path, T.line_no, T.line, coalesce(C.before, '') AS before, coalesce(C.after, '') AS after,
       g.language
FROM {source} T LEFT JOIN C ON C.project = T.project AND C.path = T.path AND C.match_ln = T.line_no
LEFT JOIN glang g ON g.gext = lower(regexp_extract(T.path, '^.*/?\\.*[^./][^/]*?(\\.[^./]+)$', 1))"""


def _files(spark, sf_dir):
    return file_tree(spark, sf_dir)


def _flat(df):
    return df.select("project", "path", "line_no", "line",
                     F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"),
                     "language")


@register("x8_deep_search", "WITH " + _LINES_SQL + f""",
T AS (SELECT * FROM M ORDER BY project, path, line_no LIMIT {LIMIT})""" + _ctx_sql("T", True))
def x8_deep_search(spark, sf_dir):
    grep.check_request(LIMIT, CONTEXT)
    return _flat(grep.search(_files(spark, sf_dir), PATTERN, CONTEXT, LIMIT, mode="reference"))


@register("w2_context", "WITH " + _LINES_SQL + _ctx_sql("M", False))
def w2_context(spark, sf_dir):
    return _flat(grep.search(_files(spark, sf_dir), PATTERN, CONTEXT, None, mode="full"))


@register("a13_matches_by_file", "WITH " + _LINES_SQL + """
SELECT project, path, count(*)::BIGINT AS n_matches, (SELECT count(*) FROM M)::BIGINT AS total_matches
FROM M GROUP BY project, path""")
def a13_matches_by_file(spark, sf_dir):
    gfiles = grep.grep_files(_files(spark, sf_dir))
    return grep.matches_by_file(grep.match_counts(gfiles, grep.bre_to_java(PATTERN)))


@register("p13_viewable", "WITH " + TREE_SQL + """
SELECT project, path, size_bytes, size_bytes <= 1048576 AS viewable,
       CASE WHEN size_bytes > 1048576 THEN 'File too large to display' END AS reason,
       CASE WHEN size_bytes <= 1048576 THEN len(string_split(content, chr(10)))::BIGINT END AS view_lines
FROM tree""")
def p13_viewable(spark, sf_dir):
    return grep.viewable(file_tree(spark, sf_dir))


@register("p14_line_range", "WITH " + TREE_SQL + r""",
norm AS (
  SELECT project, path, content,
         string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) AS pieces
  FROM tree WHERE NOT contains(content, chr(0))),
cut AS (
  SELECT project, path,
         CASE WHEN content = '' THEN []::VARCHAR[]
              WHEN right(content, 1) IN (chr(13), chr(10)) THEN pieces[1:len(pieces) - 1]
              ELSE pieces END AS pieces
  FROM norm),
L AS (SELECT project, path, unnest(range(1, len(pieces) + 1))::INTEGER AS line_no, unnest(pieces) AS line FROM cut),
req AS (
  SELECT doc_id AS request_id, project, path,
         (doc_id % 7 + 1)::INTEGER AS line_from,
         CASE WHEN doc_id % 30 = 0 THEN 0 ELSE (doc_id % 7 + 4)::INTEGER END AS line_to
  FROM tree)
SELECT r.request_id, r.project, r.path, L.line_no, L.line FROM req r JOIN L
  ON L.project = r.project AND L.path = r.path AND L.line_no BETWEEN r.line_from AND r.line_to""")
def p14_line_range(spark, sf_dir):
    files = file_tree(spark, sf_dir)
    req = files.select(F.col("doc_id").alias("request_id"), "project", "path")
    req = req.select("request_id", "project", "path",
                     (F.col("request_id") % 7 + 1).cast("int").alias("line_from"),
                     F.when(F.col("request_id") % 30 == 0, F.lit(0))
                     .otherwise(F.col("request_id") % 7 + 4).cast("int").alias("line_to"))
    return grep.line_ranges(files.where(~F.col("content").contains("\u0000")), req).select("request_id", "project", "path", "line_no", "line")
