"""Registered documentation queries.

Bindings (same recipe on both sides):

* doc files: one root-level file per document of project ``source``; the
  name is a README candidate (doc_id % 7 = 1, project number % 4 <> 0),
  METADATA.json (doc_id % 11 = 2, number % 3 <> 0), USAGE.md (doc_id % 13
  = 3, number % 5 <> 0) or ``doc<id>.txt``; READMEs of projects whose
  number % 6 = 1 hold only a short heading (too short for a README).
* metadata replies: ``events`` rows turned into JSON objects, wrapped in
  prose every 3rd row, broken every 10th.
* text replies: assistant turns of ``conversations`` wrapped in fences or
  JSON envelopes by turn.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.functions import exprs, fixed
from treeline.io import table
from treeline.operators import docs
from treeline.plans.registry import register
from treeline.sources import manifests

_README_ARR = "[" + ", ".join(f"'{n}'" for n in fixed.README_NAMES) + "]"

DOCFILES_SQL = f"""docfiles AS (
  SELECT project, name AS path, name, length(content)::BIGINT AS size_bytes, content FROM (
    SELECT source AS project,
           CASE WHEN doc_id % 7 = 1 AND pn % 4 <> 0 THEN {_README_ARR}[((doc_id // 7) % 5) + 1]
                WHEN doc_id % 11 = 2 AND pn % 3 <> 0 THEN 'METADATA.json'
                WHEN doc_id % 13 = 3 AND pn % 5 <> 0 THEN 'USAGE.md'
                ELSE 'doc' || doc_id::VARCHAR || '.txt' END AS name,
           CASE WHEN pn % 6 = 1 AND doc_id % 7 = 1 AND pn % 4 <> 0 THEN '  # ' || source || ' ' || doc_id::VARCHAR || chr(10) ELSE text END AS content
    FROM (SELECT *, regexp_extract(source, '([0-9]+)', 1)::INTEGER AS pn FROM documents))),
prio AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {i})" for i, n in enumerate(fixed.README_NAMES))}) AS p(pname, prio)),
readme AS (
  SELECT project, name AS readme_name, content AS readme FROM (
    SELECT d.*, row_number() OVER (PARTITION BY project ORDER BY p.prio, d.path, md5(d.content)) AS rn
    FROM docfiles d JOIN prio p ON d.name = p.pname) WHERE rn = 1),
state AS (
  SELECT project,
         max(CASE WHEN name = 'METADATA.json' THEN size_bytes END) AS metadata_size,
         max(CASE WHEN name = 'README.md' THEN size_bytes END) AS readme_size,
         max(CASE WHEN name = 'USAGE.md' THEN size_bytes END) AS usage_size
  FROM docfiles GROUP BY project),
projs AS (SELECT DISTINCT source AS project FROM documents),
gaps AS (
  SELECT p.project,
         r.readme IS NULL OR length(regexp_replace(regexp_replace(r.readme, '^\\s+', ''), '\\s+$', '')) < 50 AS needs_readme,
         s.metadata_size IS NULL AS needs_metadata,
         s.usage_size IS NULL AS needs_usage,
         coalesce(s.readme_size > 50, false) AS has_readme,
         coalesce(s.metadata_size > 50, false) AS has_metadata,
         coalesce(s.usage_size > 50, false) AS has_usage
  FROM projs p LEFT JOIN readme r USING (project) LEFT JOIN state s USING (project)),
kinds AS (SELECT * FROM (VALUES ('metadata', 0), ('readme', 1), ('usage', 2)) AS k(kind, kind_order)),
missing AS (
  SELECT p.project, k.kind, k.kind_order FROM projs p LEFT JOIN state s USING (project) CROSS JOIN kinds k
  WHERE CASE k.kind WHEN 'metadata' THEN s.metadata_size WHEN 'readme' THEN s.readme_size
                    ELSE s.usage_size END IS NULL)"""


def _docfiles(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pn = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    i = F.col("doc_id")
    names = F.array(*[F.lit(n) for n in fixed.README_NAMES])
    name = (F.when((i % 7 == 1) & (pn % 4 != 0), F.element_at(names, (F.floor(i / 7) % 5 + 1).cast("int")))
            .when((i % 11 == 2) & (pn % 3 != 0), F.lit("METADATA.json"))
            .when((i % 13 == 3) & (pn % 5 != 0), F.lit("USAGE.md"))
            .otherwise(F.concat(F.lit("doc"), i.cast("string"), F.lit(".txt"))))
    short = F.concat(F.lit("  # "), F.col("source"), F.lit(" "), i.cast("string"), F.lit("\n"))
    content = F.when((pn % 6 == 1) & (i % 7 == 1) & (pn % 4 != 0), short).otherwise(F.col("text"))
    return d.select(F.col("source").alias("project"), name.alias("name"), content.alias("content")).select(
        "project", F.col("name").alias("path"), "name", F.length("content").cast("long").alias("size_bytes"), "content")


def _gaps(spark, sf_dir):
    files = _docfiles(spark, sf_dir)
    projs = table(spark, sf_dir, "documents").select(F.col("source").alias("project")).distinct()
    return projs, files, docs.doc_gaps(projs, docs.pick_readme(files), docs.doc_state(files))


@register("s5_readme_pick", "WITH " + DOCFILES_SQL + "\nSELECT project, readme_name, readme FROM readme")
def s5_readme_pick(spark, sf_dir):
    return docs.pick_readme(_docfiles(spark, sf_dir))


@register("p10_doc_gaps", "WITH " + DOCFILES_SQL + "\nSELECT * FROM gaps")
def p10_doc_gaps(spark, sf_dir):
    return _gaps(spark, sf_dir)[2]


@register("j8_missing_docs", "WITH " + DOCFILES_SQL + "\nSELECT * FROM missing")
def j8_missing_docs(spark, sf_dir):
    projs, files, _ = _gaps(spark, sf_dir)
    return docs.missing_docs(projs, docs.doc_state(files))


@register("a10_dry_run", "WITH " + DOCFILES_SQL + """
SELECT count(*) FILTER (WHERE needs_metadata)::BIGINT AS metadata, count(*) FILTER (WHERE needs_readme)::BIGINT AS readme,
       count(*) FILTER (WHERE needs_usage)::BIGINT AS usage FROM gaps""")
def a10_dry_run(spark, sf_dir):
    return docs.dry_run_counts(_gaps(spark, sf_dir)[2])


_LOC_SQL = r""",
loc AS (
  SELECT source AS project,
         sum(len(regexp_split_to_array(text, '\r\n|\r|\n')) - 1 +
             CASE WHEN text <> '' AND right(text, 1) NOT IN (chr(13), chr(10)) THEN 1 ELSE 0 END)::BIGINT AS lines_of_code
  FROM documents GROUP BY source)"""


def _loc(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("project")).agg(
        F.sum(exprs.line_count(F.col("text"))).cast("long").alias("lines_of_code"))


@register("o9_work_queue", "WITH " + DOCFILES_SQL + _LOC_SQL + """
SELECT m.project, m.kind, m.kind_order, l.lines_of_code FROM missing m LEFT JOIN loc l USING (project)""")
def o9_work_queue(spark, sf_dir):
    projs, files, _ = _gaps(spark, sf_dir)
    wl = docs.missing_docs(projs, docs.doc_state(files))
    return docs.work_queue(wl, _loc(spark, sf_dir))


@register("m8_docs_worklist", "WITH " + DOCFILES_SQL + _LOC_SQL + """
SELECT m.project, m.kind, l.lines_of_code,
       '# ' || m.project || ' ' || m.kind || ' (' || l.lines_of_code::VARCHAR || ' lines)' AS text
FROM missing m LEFT JOIN loc l USING (project)""")
def m8_docs_worklist(spark, sf_dir):
    projs, files, _ = _gaps(spark, sf_dir)
    wl = docs.missing_docs(projs, docs.doc_state(files)).join(_loc(spark, sf_dir), "project", "left")
    # The generator is pluggable; this binding's generator replies with a
    # fenced heading, which the ingest side cleans like any reply.
    reply = F.concat(F.lit("```markdown\n# "), F.col("project"), F.lit(" "), F.col("kind"), F.lit(" ("),
                     F.col("lines_of_code").cast("string"), F.lit(" lines)\n```"))
    return wl.select("project", "kind", "lines_of_code", docs.clean_markdown(reply).alias("text"))


# ------------------------------------------------------------ metadata replies

def _meta_replies(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    obj = (F.when(i % 4 == 0, F.concat(
        F.lit('{"name": "p'), F.col("user_id").cast("string"), F.lit('", "keywords": [" '), F.upper("event_type"),
        F.lit(' ", "k'), (k % 5).cast("string"), F.lit('"], "short_description": "event '), i.cast("string"), F.lit('"}')))
        .when(i % 4 == 1, F.concat(F.lit('{"result": {"keywords": ["'), F.col("event_type"),
                                   F.lit('"], "primary_language": "go"}}')))
        .otherwise(F.col("props")))
    text = (F.when(i % 10 == 0, F.concat(F.lit('broken {"k": '), k.cast("string")))
            .when(i % 3 == 0, F.concat(F.lit("Here you go: "), obj, F.lit(" -- done")))
            .otherwise(obj))
    return e.select(F.col("user_id").alias("project"), "event_id", "event_type", text.alias("text"))


META_SQL = r"""replies AS (
  SELECT user_id AS project, event_id, event_type,
         CASE WHEN event_id % 10 = 0 THEN 'broken {"k": ' || k::VARCHAR
              WHEN event_id % 3 = 0 THEN 'Here you go: ' || obj || ' -- done' ELSE obj END AS text
  FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN '{"name": "p' || user_id::VARCHAR || '", "keywords": [" ' || upper(event_type)
                         || ' ", "k' || (k % 5)::VARCHAR || '"], "short_description": "event ' || event_id::VARCHAR || '"}'
                       WHEN event_id % 4 = 1 THEN '{"result": {"keywords": ["' || event_type || '"], "primary_language": "go"}}'
                       ELSE props END AS obj
        FROM (SELECT *, json_extract_string(props, '$.k')::INTEGER AS k FROM events))),
parsed0 AS (
  SELECT *, CASE WHEN json_valid(text) AND starts_with(ltrim(text), '{') THEN text
                 WHEN regexp_extract(text, '\{[\s\S]*\}', 0) <> '' AND json_valid(regexp_extract(text, '\{[\s\S]*\}', 0))
                 THEN regexp_extract(text, '\{[\s\S]*\}', 0) END AS doc
  FROM replies),
parsed AS (
  SELECT *, CASE WHEN json_extract(doc, '$.result') IS NOT NULL AND json_type(json_extract(doc, '$.result')) = 'OBJECT'
                 THEN json_extract(doc, '$.result')::VARCHAR ELSE doc END AS d
  FROM parsed0),
meta AS (
  SELECT project, event_id, CASE WHEN d IS NULL THEN 'error' ELSE 'ok' END AS status,
         CASE WHEN d IS NOT NULL THEN coalesce(json_extract_string(d, '$.name'), project::VARCHAR) END AS name,
         CASE WHEN d IS NOT NULL THEN coalesce(json_extract_string(d, '$.short_description'), '') END AS short_description,
         CASE WHEN d IS NOT NULL THEN list_transform(coalesce(json_extract_string(d, '$.keywords[*]'), []::VARCHAR[]),
                                                     lambda k: trim(lower(k))) END AS keywords,
         CASE WHEN d IS NOT NULL THEN coalesce(json_extract_string(d, '$.primary_language'), event_type) END AS primary_language,
         CASE WHEN d IS NOT NULL THEN [event_type] END AS languages,
         CASE WHEN d IS NULL THEN substr(text, 1, 200) END AS error_text
  FROM parsed)"""


@register("s6_metadata", "WITH " + META_SQL + """
SELECT project, event_id, status, name, short_description, array_to_string(keywords, ',') AS keywords,
       primary_language, array_to_string(languages, ',') AS languages, error_text FROM meta""")
def s6_metadata(spark, sf_dir):
    m = docs.parse_metadata(_meta_replies(spark, sf_dir), project_languages=F.array(F.col("event_type")))
    return m.select("project", "event_id", "status", "name", "short_description",
                    F.array_join("keywords", ",").alias("keywords"), "primary_language",
                    F.array_join("languages", ",").alias("languages"), "error_text")


@register("m7_metadata_merge", "WITH " + META_SQL + """,
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY event_id DESC) AS rn FROM meta) WHERE rn = 1),
slang AS (
  SELECT project, list(event_type ORDER BY n DESC, event_type) AS langs FROM (
    SELECT user_id AS project, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY project),
projs AS (
  SELECT DISTINCT user_id AS project, 'old' AS short_description,
         CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'lang' || (user_id % 5)::VARCHAR END AS primary_language
  FROM events)
SELECT p.project,
       CASE WHEN l.status = 'ok' THEN l.short_description ELSE p.short_description END AS short_description,
       CASE WHEN l.status = 'ok' THEN array_to_string(list_filter(list_filter(l.keywords, lambda k: k <> ''),
            lambda x, i: list_position(list_filter(l.keywords, lambda k: k <> ''), x) = i), ',') END AS keywords,
       array_to_string(CASE WHEN l.status = 'ok' THEN l.languages ELSE s.langs END, ',') AS languages,
       CASE WHEN l.status = 'ok' THEN coalesce(l.primary_language, s.langs[1])
            ELSE coalesce(p.primary_language, s.langs[1]) END AS primary_language
FROM projs p LEFT JOIN last l ON p.project = l.project LEFT JOIN slang s ON p.project = s.project""")
def m7_metadata_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    replies = _meta_replies(spark, sf_dir)
    last = replies.groupBy("project").agg(F.max(F.struct("event_id", "event_type", "text")).alias("r")).select(
        "project", F.col("r.event_id").alias("event_id"), F.col("r.event_type").alias("event_type"),
        F.col("r.text").alias("text"))
    meta = docs.parse_metadata(last, project_languages=F.array(F.col("event_type")))
    per = e.groupBy(F.col("user_id").alias("project"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    langs = per.groupBy("project").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "event_type"))).alias("s")) \
        .select("project", F.transform("s", lambda x: x["event_type"]).alias("languages"))
    projs = e.select(F.col("user_id").alias("project")).distinct().select(
        "project", F.lit("old").alias("short_description"),
        F.when(F.col("project") % 4 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("lang"), (F.col("project") % 5).cast("string"))).alias("primary_language"))
    out = docs.merge_metadata(projs, meta, langs)
    return out.select("project", "short_description", F.array_join("keywords", ",").alias("keywords"),
                      F.array_join("languages", ",").alias("languages"), "primary_language")


# ------------------------------------------------------------ text replies

def _text_replies(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    t = F.col("turn") % 6
    wrapped = (F.when(t == 0, F.concat(F.lit("```markdown\n"), F.col("text"), F.lit("\n```")))
               .when(t == 1, F.concat(F.lit("```md\n"), F.col("text"), F.lit("\n```")))
               .when(t == 2, F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```")))
               .when(t == 3, F.to_json(F.struct(F.col("text").alias("result"))))
               .when(t == 4, F.to_json(F.struct(F.col("text").alias("content"))))
               .otherwise(F.concat(F.lit("  "), F.col("text"), F.lit("\n"))))
    return c.select("conv_id", "turn", wrapped.alias("reply"))


@register("s7_clean_replies", r"""
WITH r AS (
  SELECT conv_id, turn,
         CASE turn % 6 WHEN 0 THEN '```markdown' || chr(10) || text || chr(10) || '```'
                       WHEN 1 THEN '```md' || chr(10) || text || chr(10) || '```'
                       WHEN 2 THEN '```' || chr(10) || text || chr(10) || '```'
                       WHEN 3 THEN json_object('result', text)::VARCHAR
                       WHEN 4 THEN json_object('content', text)::VARCHAR
                       ELSE '  ' || text || chr(10) END AS reply
  FROM conversations WHERE role = 'assistant'),
u AS (
  SELECT conv_id, turn,
         regexp_replace(regexp_replace(
           CASE WHEN json_valid(reply) AND starts_with(ltrim(reply), '{')
                     AND coalesce(json_extract_string(reply, '$.result'), json_extract_string(reply, '$.content'),
                                  json_extract_string(reply, '$.readme'), json_extract_string(reply, '$.usage')) IS NOT NULL
                THEN coalesce(json_extract_string(reply, '$.result'), json_extract_string(reply, '$.content'),
                              json_extract_string(reply, '$.readme'), json_extract_string(reply, '$.usage'))
                ELSE reply END, '^\s+', ''), '\s+$', '') AS c
  FROM r),
f AS (
  SELECT conv_id, turn,
         CASE WHEN starts_with(c, '```markdown') THEN substr(c, 12)
              WHEN starts_with(c, '```md') THEN substr(c, 6)
              WHEN starts_with(c, '```') THEN substr(c, 4) ELSE c END AS c
  FROM u)
SELECT conv_id, turn,
       regexp_replace(regexp_replace(CASE WHEN ends_with(c, '```') THEN substr(c, 1, length(c) - 3) ELSE c END,
                      '^\s+', ''), '\s+$', '') AS text
FROM f""")
def s7_clean_replies(spark, sf_dir):
    r = _text_replies(spark, sf_dir)
    return r.select("conv_id", "turn", docs.clean_markdown(F.col("reply")).alias("text"))


# ------------------------------------------------------------ summaries

_RESULTS_SQL = """res AS (
  SELECT conv_id AS project,
         bool_or(role = 'assistant' AND turn = 1) AS readme_generated,
         bool_or(role = 'assistant' AND turn = 3) AS metadata_generated,
         bool_or(role = 'assistant' AND turn = 5) AS usage_generated,
         max(CASE WHEN role = 'system' THEN 'failed' END) AS readme_error
  FROM conversations GROUP BY conv_id)"""


@register("a9_gen_summary", "WITH " + _RESULTS_SQL + """
SELECT count(*) FILTER (WHERE metadata_generated)::BIGINT AS metadata_ok,
       count(*) FILTER (WHERE readme_generated)::BIGINT AS readme_ok,
       count(*) FILTER (WHERE usage_generated)::BIGINT AS usage_ok,
       count(*) FILTER (WHERE readme_error IS NOT NULL)::BIGINT AS errors FROM res""")
def a9_gen_summary(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a = F.col("role") == "assistant"
    res = c.groupBy(F.col("conv_id").alias("project")).agg(
        F.max(a & (F.col("turn") == 1)).alias("readme_generated"),
        F.max(a & (F.col("turn") == 3)).alias("metadata_generated"),
        F.max(a & (F.col("turn") == 5)).alias("usage_generated"),
        F.max(F.when(F.col("role") == "system", F.lit("failed"))).alias("readme_error"),
    ).withColumn("metadata_error", F.lit(None).cast("string")).withColumn("usage_error", F.lit(None).cast("string"))
    return docs.generation_summary(res)


@register("a11_module_dedup", """
WITH m AS (
  SELECT conv_id, turn, role AS name, CASE WHEN turn % 4 = 3 THEN NULL ELSE 'p' || (turn % 3)::VARCHAR END AS path,
         text AS description
  FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, path ORDER BY turn) AS rn FROM m WHERE path IS NOT NULL AND name IS NOT NULL)
SELECT conv_id AS project, path, turn AS pos, name, coalesce(description, '') AS description FROM r WHERE rn = 1""")
def a11_module_dedup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    path = F.when(F.col("turn") % 4 != 3, F.concat(F.lit("p"), (F.col("turn") % 3).cast("string")))
    return docs.dedup_module_rows(c.select(F.col("conv_id").alias("project"), F.col("turn").alias("pos"),
                                           F.col("role").alias("name"), path.alias("path"), F.col("text").alias("description")))


# ------------------------------------------------------------ manifests

def _package_json(spark, sf_dir):
    """``events`` as package.json manifests (one per event, truncated -- so
    unreadable -- every 10th)."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    full = F.concat(F.lit('{"name": "pkg'), F.col("user_id").cast("string"), F.lit('", "version": "1.'),
                    (F.col("event_id") % 10).cast("string"), F.lit('", "dependencies": {"'), F.col("event_type"),
                    F.lit('": "^'), k.cast("string"), F.lit('.0"}, "devDependencies": {"dev'), (k % 7).cast("string"),
                    F.lit('": "~1.'), (k % 3).cast("string"), F.lit('"}}'))
    base = e.select(F.col("user_id").cast("string").alias("project"), F.lit("package.json").alias("name"),
                    full.alias("_t"), "event_id")
    content = F.when(F.col("event_id") % 10 == 0, F.expr("substring(_t, 1, length(_t) - 1)")).otherwise(F.col("_t"))
    return base.select("project", "name", content.alias("content"))


@register("s4_manifest_deps", """
WITH m AS (
  SELECT user_id::VARCHAR AS project,
         CASE WHEN event_id % 10 = 0 THEN substr(t, 1, length(t) - 1) ELSE t END AS content
  FROM (SELECT *, '{"name": "pkg' || user_id::VARCHAR || '", "version": "1.' || (event_id % 10)::VARCHAR
                  || '", "dependencies": {"' || event_type || '": "^' || k::VARCHAR || '.0"}, "devDependencies": {"dev'
                  || (k % 7)::VARCHAR || '": "~1.' || (k % 3)::VARCHAR || '"}}' AS t
        FROM (SELECT *, json_extract_string(props, '$.k')::INTEGER AS k FROM events))),
ok AS (SELECT * FROM m WHERE json_valid(content)),
d AS (
  SELECT project, unnest(json_keys(content, '$.dependencies')) AS name, 'dependencies' AS dep_type, false AS is_dev, content FROM ok
  UNION ALL
  SELECT project, unnest(json_keys(content, '$.devDependencies')), 'devDependencies', true, content FROM ok),
v AS (SELECT project, name, dep_type, is_dev,
             json_extract_string(content, '$.' || dep_type || '."' || name || '"') AS version FROM d)
SELECT project, 'npm' AS ecosystem, name, dep_type, max(is_dev) AS is_dev, max(version) AS version
FROM v GROUP BY project, name, dep_type""")
def s4_manifest_deps(spark, sf_dir):
    deps = manifests.npm_dependencies(_package_json(spark, sf_dir))
    return deps.groupBy("project", "ecosystem", "name", "dep_type").agg(
        F.max("is_dev").alias("is_dev"), F.max("version").alias("version"))


_MANIFESTS_SQL = r"""m AS (
  SELECT event_id::VARCHAR AS project, event_id % 5 AS kind,
         CASE event_id % 5 WHEN 0 THEN '{"name": "v/' || event_type || user_id::VARCHAR || '", "description": "d ' || event_type || '"}'
           WHEN 1 THEN '// c' || chr(10) || 'module example.com/' || event_type || '/' || user_id::VARCHAR || chr(10) || chr(10) || 'go 1.22' || chr(10)
           WHEN 2 THEN '[tool.poetry]' || chr(10) || 'name = "old"' || chr(10) || 'description = "d"' || chr(10) || '[project]' || chr(10)
                       || 'name = "' || event_type || '"' || chr(10) || 'dependencies = [' || chr(10) || '  "a[x]>=' || user_id::VARCHAR || '",' || chr(10) || '  ''b'' ]' || chr(10)
           WHEN 3 THEN '[package]' || chr(10) || 'name = "' || event_type || '"' || chr(10) || 'version = "0.' || user_id::VARCHAR || '.0"' || chr(10)
           ELSE 'from setuptools import setup' || chr(10) END AS content
  FROM events)"""


def _other_manifests(spark, sf_dir):
    """``events`` as manifests of five kinds, one project each."""
    e = table(spark, sf_dir, "events")
    i, t, u = F.col("event_id"), F.col("event_type"), F.col("user_id").cast("string")
    kind = i % 5
    name = (F.when(kind == 0, "composer.json").when(kind == 1, "go.mod").when(kind == 2, "pyproject.toml")
            .when(kind == 3, "Cargo.toml").otherwise("setup.py"))
    content = (F.when(kind == 0, F.concat(F.lit('{"name": "v/'), t, u, F.lit('", "description": "d '), t, F.lit('"}')))
               .when(kind == 1, F.concat(F.lit("// c\nmodule example.com/"), t, F.lit("/"), u, F.lit("\n\ngo 1.22\n")))
               .when(kind == 2, F.concat(F.lit('[tool.poetry]\nname = "old"\ndescription = "d"\n[project]\nname = "'), t,
                                         F.lit('"\ndependencies = [\n  "a[x]>='), u, F.lit('",\n  \'b\' ]\n')))
               .when(kind == 3, F.concat(F.lit('[package]\nname = "'), t, F.lit('"\nversion = "0.'), u, F.lit('.0"\n')))
               .otherwise(F.lit("from setuptools import setup\n")))
    return e.select(i.cast("string").alias("project"), name.alias("name"), content.alias("content"))


@register("s4_package_info", "WITH " + _MANIFESTS_SQL + r"""
SELECT project, CASE kind WHEN 0 THEN 'composer' WHEN 1 THEN 'go' WHEN 3 THEN 'cargo' ELSE 'python' END AS ecosystem,
  CASE kind WHEN 0 THEN json_extract_string(content, '$.name') WHEN 1 THEN regexp_extract(content, 'module (\S+)', 1)
    WHEN 2 THEN regexp_extract(content, '\[project\]\s+name = "([^"]*)"', 1) WHEN 3 THEN regexp_extract(content, 'name = "([^"]*)"', 1) ELSE project END AS name,
  CASE kind WHEN 3 THEN regexp_extract(content, 'version = "([^"]*)"', 1) END AS version,
  CASE kind WHEN 0 THEN json_extract_string(content, '$.description') WHEN 2 THEN 'd' END AS description
FROM m""")
def s4_package_info(spark, sf_dir):
    return manifests.package_info(_other_manifests(spark, sf_dir)).drop("has_file")


@register("s4_python_deps", "WITH " + _MANIFESTS_SQL + r"""
SELECT project, 'python' AS ecosystem, unnest(['a[x]>=' || regexp_extract(content, '>=([0-9]+)', 1), 'b']) AS name FROM m WHERE kind = 2""")
def s4_python_deps(spark, sf_dir):
    return manifests.dependencies(_other_manifests(spark, sf_dir)).select("project", "ecosystem", "name")
