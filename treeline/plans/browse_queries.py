"""Registered catalog-read queries over the ``customer``-as-projects binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.io import table
from treeline.operators import browse
from treeline.operators.docs import dedup_keyword_rows
from treeline.plans.registry import register
from treeline.plans.standins import (BRIDGE_SQL, MODULES_SQL, PROJECTS_SQL, keyword_bridge, modules,
                                     projects)

W = "WITH " + PROJECTS_SQL + ",\n" + BRIDGE_SQL + ",\n" + MODULES_SQL


@register("o1_browse", W + """,
f AS (SELECT * FROM proj WHERE primary_language = 'building'
      AND id IN (SELECT project_id FROM bridge WHERE keyword = 'promo')),
t AS (SELECT count(*)::BIGINT AS total, ((count(*) + 49) // 50)::BIGINT AS total_pages FROM f),
p AS (SELECT * FROM f ORDER BY last_code_modified_at DESC NULLS LAST, name, id LIMIT 50 OFFSET 50)
SELECT id, name, last_code_modified_at, total, total_pages FROM p, t""")
def o1_browse(spark, sf_dir):
    r = browse.browse(projects(spark, sf_dir), keyword_bridge(spark, sf_dir), language="building",
                      keyword="PROMO", sort="recent", page=2)
    return r.select("id", "name", "last_code_modified_at", "total", "total_pages")


@register("o2_list", W + "\nSELECT id, name FROM proj ORDER BY name, id LIMIT 50 OFFSET 100")
def o2_list(spark, sf_dir):
    return browse.list_projects(projects(spark, sf_dir), limit=50, offset=100).select("id", "name")


@register("o3_top_keywords", W + """
SELECT keyword, count(*)::BIGINT AS project_count FROM bridge GROUP BY keyword
ORDER BY project_count DESC, keyword LIMIT 20""")
def o3_top_keywords(spark, sf_dir):
    return browse.top_keywords(keyword_bridge(spark, sf_dir), 20)


@register("o4_top_languages", W + """
SELECT primary_language, count(*)::BIGINT AS project_count FROM proj WHERE primary_language IS NOT NULL
GROUP BY 1 ORDER BY project_count DESC, primary_language LIMIT 10""")
def o4_top_languages(spark, sf_dir):
    return browse.top_languages(projects(spark, sf_dir), 10)


@register("o5_recent", W + "\nSELECT id, name, scanned_at FROM proj ORDER BY scanned_at DESC NULLS LAST, id LIMIT 10")
def o5_recent(spark, sf_dir):
    return browse.recent(projects(spark, sf_dir), 10).select("id", "name", "scanned_at")


@register("p5_lang_filter", W + "\nSELECT id, name, primary_language FROM proj WHERE primary_language = 'machinery'")
def p5_lang_filter(spark, sf_dir):
    return browse.filter_language(projects(spark, sf_dir), "machinery").select("id", "name", "primary_language")


@register("p6_keyword_filter", W + """
SELECT id, name FROM proj WHERE id IN (SELECT project_id FROM bridge WHERE keyword = 'brand#13')""")
def p6_keyword_filter(spark, sf_dir):
    return browse.filter_keyword(projects(spark, sf_dir), keyword_bridge(spark, sf_dir), "Brand#13").select("id", "name")


@register("p7_lookup", W + """
SELECT id, name, coalesce(readme_content, 'No README available') AS readme FROM proj
WHERE name IN ('Customer#000000042', 'Customer#000000043')""")
def p7_lookup(spark, sf_dir):
    p = projects(spark, sf_dir)
    a = browse.lookup(p, "Customer#000000042")
    b = browse.lookup(p, "Customer#000000043")
    return a.unionByName(b).select("id", "name", "readme")


@register("p8_like_search", W + """
SELECT id, name FROM proj
WHERE contains(lower(name), 'r#00000012') OR contains(lower(coalesce(short_description, '')), 'r#00000012')
ORDER BY name, id LIMIT 20""")
def p8_like_search(spark, sf_dir):
    return browse.like_search(projects(spark, sf_dir), "R#00000012", 20).select("id", "name")


@register("a5_keyword_facet", W + "\nSELECT keyword, count(*)::BIGINT AS project_count FROM bridge GROUP BY keyword")
def a5_keyword_facet(spark, sf_dir):
    return browse.keyword_facet(keyword_bridge(spark, sf_dir))


@register("a6_language_facet", W + """
SELECT primary_language, count(*)::BIGINT AS project_count FROM proj WHERE primary_language IS NOT NULL GROUP BY 1""")
def a6_language_facet(spark, sf_dir):
    return browse.language_facet(projects(spark, sf_dir))


@register("a7_totals", W + """
SELECT p.*, m.modules, k.keywords FROM
 (SELECT count(*)::BIGINT AS projects, coalesce(sum(lines_of_code), 0)::BIGINT AS total_loc,
         count(*) FILTER (WHERE is_git_repo)::BIGINT AS git_repos,
         count(readme_content)::BIGINT AS with_readme, count(metadata_json)::BIGINT AS with_metadata FROM proj) p,
 (SELECT count(*)::BIGINT AS modules FROM mods) m,
 (SELECT count(DISTINCT keyword)::BIGINT AS keywords FROM bridge) k""")
def a7_totals(spark, sf_dir):
    return browse.totals(projects(spark, sf_dir), modules(spark, sf_dir), keyword_bridge(spark, sf_dir))


@register("a8_scan_summary", W + """
SELECT count(*)::BIGINT AS projects, count(*) FILTER (WHERE is_git_repo)::BIGINT AS git_repos,
       coalesce(sum(lines_of_code), 0)::BIGINT AS total_loc FROM proj""")
def a8_scan_summary(spark, sf_dir):
    return browse.scan_summary(projects(spark, sf_dir))


@register("j1_keyword_join", W + """
SELECT p.id, p.name, b.keyword FROM proj p JOIN bridge b ON p.id = b.project_id""")
def j1_keyword_join(spark, sf_dir):
    return browse.keyword_join(projects(spark, sf_dir), keyword_bridge(spark, sf_dir)).select("id", "name", "keyword")


@register("j11_project_doc", W + """,
child AS (SELECT project_id AS id, 'keyword' AS kind, NULL::BIGINT AS child_id, keyword AS name, NULL::VARCHAR AS path,
                 NULL::VARCHAR AS description FROM bridge
          UNION ALL SELECT project_id, 'module', module_id, name, path, description FROM mods)
SELECT * FROM child WHERE id IN (SELECT id FROM proj)""")
def j11_project_doc(spark, sf_dir):
    return browse.project_children(projects(spark, sf_dir), keyword_bridge(spark, sf_dir), modules(spark, sf_dir))


@register("o2_list_keyword", W + """
SELECT id, name FROM proj WHERE id IN (SELECT project_id FROM bridge WHERE keyword = 'brand#13')
ORDER BY name, id LIMIT 100""")
def o2_list_keyword(spark, sf_dir):
    return browse.list_projects(projects(spark, sf_dir), limit=100, bridge=keyword_bridge(spark, sf_dir),
                                keyword="Brand#13").select("id", "name")


@register("o1_browse_past_end", W + """,
t AS (SELECT count(*)::BIGINT AS total, ((count(*) + 49) // 50)::BIGINT AS total_pages FROM proj)
SELECT NULL::BIGINT AS id, total, total_pages FROM t""")
def o1_browse_past_end(spark, sf_dir):
    return browse.browse(projects(spark, sf_dir), page=10_000_000).select("id", "total", "total_pages")


@register("a12_keyword_dedup", """
WITH raw AS (
  SELECT o.o_custkey AS project_id,
         list(CASE WHEN l.l_linenumber % 2 = 0 THEN ' ' || upper(p.p_type) || ' ' ELSE p.p_type END
              ORDER BY l.l_orderkey, l.l_linenumber,
                       CASE WHEN l.l_linenumber % 2 = 0 THEN ' ' || upper(p.p_type) || ' ' ELSE p.p_type END) AS kw
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY 1),
n AS (SELECT project_id, list_filter(list_transform(kw, lambda k: trim(lower(k))), lambda k: k <> '') AS kw FROM raw)
SELECT project_id, array_to_string(list_filter(kw, lambda x, i: list_position(kw, x) = i), ',') AS keywords FROM n""")
def a12_keyword_dedup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    raw = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" "), F.upper("p_type"), F.lit(" "))).otherwise(F.col("p_type"))
    rows = j.select(F.col("o_custkey").alias("project_id"), raw.alias("keyword"),
                    F.struct("l_orderkey", "l_linenumber", raw.alias("k")).alias("pos"))
    return dedup_keyword_rows(rows).select("project_id", F.array_join("keywords", ",").alias("keywords"))
