"""Registered inventory queries (S1-S3, P1-P3, A1-A3, O8) over the
``documents``-as-file-tree binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.functions import exprs, fixed
from treeline.operators import scan
from treeline.plans.registry import register
from treeline.plans.standins import TREE_SQL, file_tree

# ----------------------------------------------------------- SQL fragments

_EXCL_RX = exprs.excluded_dir_regex()
_LANG_VALUES = ", ".join(f"('{e}', '{l}')" for e, l in fixed.LANGUAGE_EXTENSIONS)
_SUFFIX = r"lower(regexp_extract(name, '^\.*[^.].*?(\.[^.]+)$', 1))"
_EXCLUDED = (f"len(list_filter(string_split(path, '/')[1:len(string_split(path, '/')) - 1], "
             f"lambda c: regexp_matches(c, '{_EXCL_RX}'))) > 0")
_LINES = (r"(len(regexp_split_to_array(content, '\r\n|\r|\n')) - 1 + "
          r"CASE WHEN content <> '' AND right(content, 1) NOT IN (chr(13), chr(10)) THEN 1 ELSE 0 END)")

_FLAGGED = TREE_SQL + f""",
langs AS (SELECT * FROM (VALUES {_LANG_VALUES}) AS l(lext, language)),
flagged AS (
  SELECT t.*, {_SUFFIX} AS ext, {_EXCLUDED} AS excluded, starts_with(name, '.') AS hidden,
         len(string_split(path, '/')) AS depth
  FROM tree t),
withlang AS (SELECT f.*, l.language FROM flagged f LEFT JOIN langs l ON f.ext = l.lext)"""

_MARKERS = ", ".join(f"'{m}'" for m in fixed.PROJECT_MARKERS)
_SOURCE_NAME = " OR ".join(f"ends_with(name, '{e}')" for e, _ in fixed.LANGUAGE_EXTENSIONS)

_PROJECT_TEST = TREE_SQL + f""",
pt AS (
  SELECT project,
         bool_or(split_part(path, '/', 1) IN ({_MARKERS})) AS has_marker,
         bool_or(len(string_split(path, '/')) <= 2 AND ({_SOURCE_NAME})) AS has_shallow_source
  FROM tree GROUP BY project)"""


def _files(spark, sf_dir, content=True):
    return file_tree(spark, sf_dir, with_content=content)


# ------------------------------------------------------------------ queries

@register("p1_exclude", "WITH " + _FLAGGED + "\nSELECT project, path, excluded FROM flagged")
def p1_exclude(spark, sf_dir):
    f = scan.with_flags(_files(spark, sf_dir, False))
    return f.select("project", "path", "excluded")


@register("p2_is_project", "WITH " + _PROJECT_TEST +
          "\nSELECT project, has_marker, has_shallow_source, has_marker OR has_shallow_source AS is_project FROM pt")
def p2_is_project(spark, sf_dir):
    return scan.project_test(_files(spark, sf_dir, False))


@register("p3_language", "WITH " + _FLAGGED + "\nSELECT project, path, ext, language FROM withlang")
def p3_language(spark, sf_dir):
    return scan.with_language(_files(spark, sf_dir, False)).select("project", "path", "ext", "language")


@register("s1_discover", "WITH " + _PROJECT_TEST + f"""
SELECT project, has_marker, has_shallow_source FROM pt
WHERE (has_marker OR has_shallow_source) AND NOT regexp_matches(project, '{_EXCL_RX}')""")
def s1_discover(spark, sf_dir):
    return scan.discover(_files(spark, sf_dir, False))


@register("s2_files", "WITH " + _FLAGGED + """
SELECT project, path, name, size_bytes, modified_at, language FROM withlang
WHERE NOT excluded AND NOT hidden""")
def s2_files(spark, sf_dir):
    return scan.inventory(_files(spark, sf_dir, False))


_S3_SQL = "WITH " + TREE_SQL + r""",
norm AS (
  SELECT project, path, content,
         string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) AS pieces
  FROM tree WHERE NOT contains(content, chr(0))),
cut AS (
  SELECT project, path,
         CASE WHEN content = '' THEN []::VARCHAR[]
              WHEN right(content, 1) IN (chr(13), chr(10)) THEN pieces[1:len(pieces) - 1]
              ELSE pieces END AS pieces
  FROM norm)
SELECT project, path, unnest(range(1, len(pieces) + 1))::INTEGER AS line_no, unnest(pieces) AS line FROM cut"""


@register("s3_lines", _S3_SQL)
def s3_lines(spark, sf_dir):
    return scan.lines(_files(spark, sf_dir))


@register("a1_project_stats", "WITH " + _FLAGGED + f"""
SELECT project, count(*)::BIGINT AS file_count, sum(size_bytes)::BIGINT AS size_bytes,
       sum(CASE WHEN language IS NOT NULL THEN {_LINES} ELSE 0 END)::BIGINT AS lines_of_code
FROM withlang WHERE NOT excluded GROUP BY project""")
def a1_project_stats(spark, sf_dir):
    return scan.project_stats(_files(spark, sf_dir))


@register("a2_languages", "WITH " + _FLAGGED + f""",
per AS (SELECT project, language, sum({_LINES})::BIGINT AS loc FROM withlang
        WHERE NOT excluded AND language IS NOT NULL GROUP BY project, language)
SELECT project, string_agg(language, ',' ORDER BY loc DESC, language) AS languages,
       first(language ORDER BY loc DESC, language) AS primary_language
FROM per GROUP BY project""")
def a2_languages(spark, sf_dir):
    r = scan.languages(_files(spark, sf_dir))
    return r.select("project", F.array_join("languages", ",").alias("languages"), "primary_language")


_CODE_EXTRA = ", ".join(f"'{e}'" for e in fixed.CODE_DATE_EXTRA_EXTENSIONS)
_GENERATED = ", ".join(f"'{n}'" for n in fixed.GENERATED_FILES)


@register("a3_project_dates", "WITH " + _FLAGGED + f"""
SELECT project, min(modified_at) AS project_created_at,
       max(CASE WHEN name NOT IN ({_GENERATED}) AND (language IS NOT NULL OR ext IN ({_CODE_EXTRA}))
                THEN modified_at END) AS last_code_modified_at
FROM withlang WHERE NOT excluded AND NOT hidden GROUP BY project""")
def a3_project_dates(spark, sf_dir):
    return scan.project_dates(_files(spark, sf_dir, False))


_IGNORED = ", ".join(f"'{n}'" for n in fixed.CHANGE_IGNORED_FILES)


@register("a4_latest_mtime", "WITH " + _FLAGGED + f"""
SELECT project, max(modified_at) AS latest_mtime FROM flagged
WHERE NOT excluded AND NOT hidden AND name NOT IN ({_IGNORED}) GROUP BY project""")
def a4_latest_mtime(spark, sf_dir):
    return scan.latest_mtime(_files(spark, sf_dir, False))


@register("o8_dir_listing", "WITH " + _FLAGGED + """,
inv AS (SELECT project, path, size_bytes, modified_at, language, string_split(path, '/') AS parts
        FROM withlang WHERE NOT excluded AND NOT hidden),
e AS (SELECT *, unnest(range(len(parts))) AS i FROM inv)
SELECT DISTINCT project, array_to_string(parts[1:i], '/') AS dir, parts[i + 1] AS name,
       array_to_string(parts[1:i + 1], '/') AS path, i < len(parts) - 1 AS is_directory,
       CASE WHEN i < len(parts) - 1 THEN 0 ELSE size_bytes END::BIGINT AS size_bytes,
       CASE WHEN i < len(parts) - 1 THEN NULL ELSE modified_at END AS modified_at,
       CASE WHEN i < len(parts) - 1 THEN NULL ELSE language END AS language
FROM e""")
def o8_dir_listing(spark, sf_dir):
    return scan.directory_listings(scan.inventory(_files(spark, sf_dir, False)))


@register("f_report", "WITH " + TREE_SQL + r""",
p AS (SELECT *, string_split(path, '/') AS parts, date_diff('second', TIMESTAMP '2024-01-01 00:00:00', modified_at) AS s FROM tree)
SELECT doc_id, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[1:i], '/')), '|') AS crumbs,
  CASE WHEN starts_with(path, 'src/') THEN substr(path, 5) ELSE path END AS below_src,
  CASE WHEN length(content) > 40 THEN substr(content, 1, 37) || '...' ELSE content END AS shown,
  CASE WHEN size_bytes < 1024 THEN size_bytes::VARCHAR || ' B'
       WHEN size_bytes < 1048576 THEN printf('%.1f KB', size_bytes / 1024.0) ELSE printf('%.1f MB', size_bytes / 1048576.0) END AS size,
  CASE WHEN s < 1 THEN 'just now' WHEN s < 60 THEN s::VARCHAR || ' second' || CASE WHEN s <> 1 THEN 's' ELSE '' END || ' ago'
       WHEN s < 3600 THEN (s // 60)::VARCHAR || ' minute' || CASE WHEN s // 60 <> 1 THEN 's' ELSE '' END || ' ago'
       WHEN s < 86400 THEN (s // 3600)::VARCHAR || ' hour' || CASE WHEN s // 3600 <> 1 THEN 's' ELSE '' END || ' ago'
       WHEN s < 604800 THEN (s // 86400)::VARCHAR || ' day' || CASE WHEN s // 86400 <> 1 THEN 's' ELSE '' END || ' ago'
       ELSE (s // 604800)::VARCHAR || ' week' || CASE WHEN s // 604800 <> 1 THEN 's' ELSE '' END || ' ago' END AS age,
  round(100.0 * (doc_id % 7) / 7, 1) AS percent,
  to_json([project, name])::VARCHAR AS encoded, project || ',' || name AS decoded
FROM p""")
def f_report(spark, sf_dir):
    """Report expressions F4, F6, F8, F11, F12 over the file tree (age: as of each file's time, of the first one)."""
    t = file_tree(spark, sf_dir)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    encoded = exprs.to_json_string_array(F.array("project", "name"))
    return t.select(
        "doc_id", F.array_join(exprs.breadcrumbs(F.col("path")), "|").alias("crumbs"), exprs.relative_to(F.col("path"), "src").alias("below_src"),
        exprs.ellipsize(F.col("content"), 40).alias("shown"), exprs.size_text(F.col("size_bytes")).alias("size"),
        exprs.relative_age(start, F.col("modified_at")).alias("age"), exprs.percent(F.col("doc_id") % 7, F.lit(7)).alias("percent"),
        encoded.alias("encoded"), F.array_join(exprs.json_string_array(encoded), ",").alias("decoded"))
