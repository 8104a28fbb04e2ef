"""Project documentation: README pick (S5), metadata ingestion (S6),
generated-text clean-up (S7), doc gaps and work lists (P10, J8, A10, O9,
M8), generation summaries (A9), module / keyword normalisation (A11, A12)
and the metadata merge into the catalog (M7).

Replies of an external generator arrive as text rows; everything here is
column expressions plus joins keyed by project.  JSON is parsed with
``try_parse_json`` / ``get_json_object`` (JVM side); nothing is decoded in
Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import exprs, fixed
from treeline.operators.common import small_table

_JSON_SPAN = r"\{[\s\S]*\}"


def strip_ws(c: Column) -> Column:
    """Remove leading and trailing whitespace (not only spaces)."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+\z", "")


# ---------------------------------------------------------------- README

def readme_priority_table(spark) -> DataFrame:
    return small_table(spark, [(n, i) for i, n in enumerate(fixed.README_NAMES)], "name string, prio int")


def pick_readme(files: DataFrame) -> DataFrame:
    """Per project the root-level README with the best name priority.

    ``files(project, path, name, content)``; rows with the same path (which a
    real folder cannot hold) fall to the smaller digest of the content.
    Output: project, readme_name, readme.
    """
    pr = F.broadcast(readme_priority_table(files.sparkSession))
    root = files.where(~F.col("path").contains("/"))
    c = root.join(pr, "name")
    # chosen on slim columns; only the chosen file's text is read and moved
    best = c.groupBy("project").agg(F.min(F.struct("prio", "path", "name", F.md5("content").alias("md5"))).alias("b"))
    best = best.select("project", "b.path", F.col("b.name").alias("readme_name"), "b.md5")
    text = root.select("project", "path", F.md5("content").alias("md5"), "content").join(best, ["project", "path", "md5"])
    return text.dropDuplicates(["project", "path", "md5"]).select("project", "readme_name", F.col("content").alias("readme"))


# -------------------------------------------------------------- metadata

def _is_object(v: Column) -> Column:
    """A parsed variant holds a JSON object."""
    return F.schema_of_variant(v).startswith("OBJECT")


def parse_metadata(replies: DataFrame, project_languages: Column | None = None,
                   project_name: Column | None = None) -> DataFrame:
    """Metadata records from generator replies.

    ``replies(project, text)``.  The reply is parsed once into a VARIANT
    (whole text, else the widest ``{...}`` span); a nested ``result`` object
    is unwrapped; missing fields get defaults (name = project,
    short_description = '', keywords = [], languages = the scanned
    languages, primary_language = their first); keywords are lower-cased
    and trimmed.  Rows that do not parse get ``status = 'error'`` and the
    first 200 characters in ``error_text`` (quarantine), never an exception.
    """
    langs = project_languages if project_languages is not None else F.array().cast("array<string>")
    pname = project_name if project_name is not None else F.col("project").cast("string")
    whole = F.try_parse_json(F.col("text"))
    span = F.regexp_extract(F.col("text"), _JSON_SPAN, 0)
    r = replies.withColumn("_w", whole)
    r = r.withColumn("_v", F.when(F.col("_w").isNotNull() & _is_object(F.col("_w")), F.col("_w"))
                     .otherwise(F.when(span != "", F.try_parse_json(span))))
    r = r.withColumn("_v", F.when(F.col("_v").isNotNull() & _is_object(F.col("_v")), F.col("_v")))
    res = F.try_variant_get(F.col("_v"), "$.result", "variant")
    r = r.withColumn("_d", F.when(res.isNotNull() & _is_object(res), res).otherwise(F.col("_v")))
    r = r.withColumn("_langs", langs)

    def get(path, typ="string"):
        return F.try_variant_get(F.col("_d"), path, typ)

    ok = F.col("_d").isNotNull()
    kw = get("$.keywords", "array<string>")
    return r.select(
        *[c for c in replies.columns],
        F.when(ok, F.lit("ok")).otherwise(F.lit("error")).alias("status"),
        F.when(ok, F.coalesce(get("$.name"), pname)).alias("name"),
        F.when(ok, F.coalesce(get("$.short_description"), F.lit(""))).alias("short_description"),
        F.when(ok, F.transform(F.coalesce(kw, F.array().cast("array<string>")),
                               lambda k: F.trim(F.lower(k)))).alias("keywords"),
        F.when(ok, F.coalesce(get("$.languages", "array<string>"), F.col("_langs"))).alias("languages"),
        F.when(ok, F.coalesce(get("$.primary_language"), F.element_at(F.col("_langs"), 1))).alias("primary_language"),
        F.when(ok, F.to_json(get("$.modules", "variant"))).alias("modules_json"),
        F.when(~ok, F.substring(F.col("text"), 1, 200)).alias("error_text"),
    )


# ------------------------------------------------------------ text replies

def unwrap_reply(text: Column) -> Column:
    """Reply envelope: a JSON object's ``result`` (string kept, other values
    re-encoded), else ``content``, else ``response``, else the text."""
    is_obj = F.try_parse_json(text).isNotNull() & strip_ws(text).startswith("{")
    val = F.coalesce(F.get_json_object(text, "$.result"), F.get_json_object(text, "$.content"),
                     F.get_json_object(text, "$.response"))
    return F.when(is_obj & val.isNotNull(), val).otherwise(text)


def clean_markdown(text: Column) -> Column:
    """Unwrap result / content / readme / usage of a JSON object, strip
    one surrounding code fence (```markdown, ```md or ```), trim."""
    is_obj = F.try_parse_json(text).isNotNull() & strip_ws(text).startswith("{")
    val = F.coalesce(F.get_json_object(text, "$.result"), F.get_json_object(text, "$.content"),
                     F.get_json_object(text, "$.readme"), F.get_json_object(text, "$.usage"))
    c = strip_ws(F.when(is_obj & val.isNotNull(), val).otherwise(text))
    c = (F.when(c.startswith("```markdown"), F.substring(c, 12, 1 << 30))
         .when(c.startswith("```md"), F.substring(c, 6, 1 << 30))
         .when(c.startswith("```"), F.substring(c, 4, 1 << 30))
         .otherwise(c))
    c = F.when(c.endswith("```"), F.substring(c, F.lit(1), F.length(c) - 3)).otherwise(c)
    return strip_ws(c)


# ------------------------------------------------------------ gaps, queues

def doc_state(files: DataFrame) -> DataFrame:
    """Per project: which generated documents exist, their sizes, README text.

    ``files(project, path, name, size_bytes, content)`` -- root level only.
    """
    root = files.where(~F.col("path").contains("/"))
    return root.groupBy("project").agg(
        F.max(F.when(F.col("name") == "METADATA.json", F.col("size_bytes"))).alias("metadata_size"),
        F.max(F.when(F.col("name") == "README.md", F.col("size_bytes"))).alias("readme_size"),
        F.max(F.when(F.col("name") == "USAGE.md", F.col("size_bytes"))).alias("usage_size"),
    )


def doc_gaps(projects: DataFrame, readme: DataFrame, state: DataFrame, force: bool = False,
             skip_readme: bool = False, skip_usage: bool = False) -> DataFrame:
    """P10: per project the generation predicates.

    ``needs_readme``: README missing or shorter than 50 stripped chars;
    ``needs_metadata``: METADATA.json missing; ``needs_usage``: USAGE.md
    missing; ``force`` / skip flags as in the generator.  ``has_*`` give the
    endpoint variant (file larger than 50 bytes exists).
    """
    j = projects.select("project").join(readme.select("project", "readme"), "project", "left") \
        .join(state, "project", "left")
    short = F.col("readme").isNull() | (F.length(strip_ws(F.col("readme"))) < fixed.README_MIN_CHARS)
    f = F.lit(force)
    return j.select(
        "project",
        (F.lit(not skip_readme) & (f | short)).alias("needs_readme"),
        (f | F.col("metadata_size").isNull()).alias("needs_metadata"),
        (F.lit(not skip_usage) & (f | F.col("usage_size").isNull())).alias("needs_usage"),
        F.coalesce(F.col("readme_size") > 50, F.lit(False)).alias("has_readme"),
        F.coalesce(F.col("metadata_size") > 50, F.lit(False)).alias("has_metadata"),
        F.coalesce(F.col("usage_size") > 50, F.lit(False)).alias("has_usage"),
    )


def missing_docs(projects: DataFrame, state: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(project, kind) pairs to generate -- requested kinds without the file.

    The kinds table has at most three rows, so the cross product with
    projects is linear in the number of projects.
    """
    kinds = kinds or list(fixed.DOC_KINDS)
    if not kinds:
        raise ValueError("at least one document kind is required")
    spark = projects.sparkSession
    k = F.broadcast(small_table(spark, [(x, i) for i, x in enumerate(fixed.DOC_KINDS) if x in kinds],
                                "kind string, kind_order int"))
    j = projects.select("project").join(state, "project", "left").crossJoin(k)
    present = (F.when(F.col("kind") == "metadata", F.col("metadata_size"))
               .when(F.col("kind") == "readme", F.col("readme_size"))
               .otherwise(F.col("usage_size")))
    return j.where(present.isNull()).select("project", "kind", "kind_order")


def work_queue(worklist: DataFrame, sizes: DataFrame) -> DataFrame:
    """Generation order -- projects by LOC desc, then name; within a
    project METADATA first.  The order is a sort (range-partitioned, no
    single-task window); consumers read the queue in this order."""
    j = worklist.join(sizes, "project", "left")
    return j.orderBy(F.desc_nulls_last("lines_of_code"), F.asc("project"), F.asc("kind_order"))


def dry_run_counts(gaps: DataFrame) -> DataFrame:
    """A10: how many projects each document kind would be generated for."""
    return gaps.agg(
        F.count_if("needs_metadata").alias("metadata"),
        F.count_if("needs_readme").alias("readme"),
        F.count_if("needs_usage").alias("usage"),
    )


def generation_summary(results: DataFrame) -> DataFrame:
    """Successes per kind and the number of projects with any error.

    ``results(project, readme_generated, metadata_generated, usage_generated,
    readme_error, metadata_error, usage_error)``.
    """
    any_err = (F.col("readme_error").isNotNull() | F.col("metadata_error").isNotNull()
               | F.col("usage_error").isNotNull())
    return results.agg(
        F.count_if("metadata_generated").alias("metadata_ok"),
        F.count_if("readme_generated").alias("readme_ok"),
        F.count_if("usage_generated").alias("usage_ok"),
        F.count_if(any_err).alias("errors"),
    )


# ------------------------------------------------------------- modules

def dedup_keyword_rows(rows: DataFrame) -> DataFrame:
    """``project_id, keywords`` from rows (project_id, keyword, pos):
    lower-cased and trimmed, empties dropped, ordered by first position.
    Repeats are reduced to their first position before anything is
    collected, so an array holds a project's distinct keywords only."""
    k = rows.select("project_id", F.trim(F.lower("keyword")).alias("keyword"), "pos").where("keyword <> ''")
    first = k.groupBy("project_id", "keyword").agg(F.min("pos").alias("pos"))
    return first.groupBy("project_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "keyword"))), lambda x: x["keyword"]).alias("keywords"))


def dedup_module_rows(entries: DataFrame, project_col: str = "project") -> DataFrame:
    """Module entries (project, pos, name, path, description), one row
    each -- those with name and path, the smallest ``pos`` per path kept.
    Positions are reduced before any text moves; nothing is collected."""
    m = entries.where(F.col("name").isNotNull() & F.col("path").isNotNull())
    first = m.groupBy(project_col, "path").agg(F.min("pos").alias("pos"))
    return m.join(first, [project_col, "path", "pos"], "left_semi").select(
        project_col, "path", "pos", "name", F.coalesce("description", F.lit("")).alias("description"))


def dedup_modules(meta: DataFrame, project_col: str = "project") -> DataFrame:
    """Modules of a metadata record, as in :func:`dedup_module_rows`;
    ``modules_json`` is a JSON array."""
    arr = F.from_json(F.col("modules_json"), "array<struct<name:string,path:string,description:string>>")
    m = meta.select(project_col, F.posexplode(F.coalesce(arr, F.array())).alias("pos", "m"))
    return dedup_module_rows(m.select(project_col, "pos", "m.*"), project_col)


def merge_metadata(projects: DataFrame, meta: DataFrame, languages: DataFrame) -> DataFrame:
    """M7: catalog columns after a save.

    With parsed metadata: descriptions, keywords and languages come from it
    and the primary language is metadata's, else the first scanned language.
    Without metadata only the languages are refreshed (primary kept, else
    first scanned language).
    """
    m = meta.where(F.col("status") == "ok").select(
        "project", F.col("short_description").alias("m_short"), F.col("keywords").alias("m_keywords"),
        F.col("languages").alias("m_languages"), F.col("primary_language").alias("m_primary"))
    j = projects.join(m, "project", "left").join(languages.select("project", F.col("languages").alias("s_languages")),
                                                  "project", "left")
    has = F.col("m_short").isNotNull()
    first_scanned = F.element_at(F.col("s_languages"), 1)
    return j.select(
        "project",
        F.when(has, F.col("m_short")).otherwise(F.col("short_description")).alias("short_description"),
        F.when(has, exprs.normalize_keywords(F.col("m_keywords"))).alias("keywords"),
        F.when(has, F.col("m_languages")).otherwise(F.col("s_languages")).alias("languages"),
        F.when(has, F.coalesce(F.col("m_primary"), first_scanned))
        .otherwise(F.coalesce(F.col("primary_language"), first_scanned)).alias("primary_language"),
    )


#: Buckets of projects that each kind's documents are stored in.
DOC_BUCKETS = 64


def write_docs(docs_df: DataFrame, root: str) -> None:
    """Generated documents as a table ``docs(project, kind, text)``
    partitioned by kind and project bucket.  A re-run replaces the (project,
    kind) pairs it regenerated and keeps all others: only the touched
    buckets are rewritten, merged with what they held."""
    from treeline.session import materialize, path_exists

    spark = docs_df.sparkSession
    bucket = F.pmod(F.xxhash64("project"), F.lit(DOC_BUCKETS)).cast("int")
    new = materialize(docs_df.select("project", "kind", "text").withColumn("bucket", bucket), "stage")
    if path_exists(spark, root):
        old = spark.read.parquet(root).select("project", "kind", "text", "bucket")
        touched = new.select("kind", "bucket").distinct()
        kept = (old.join(touched, ["kind", "bucket"], "left_semi")
                .join(new.select("project", "kind"), ["project", "kind"], "left_anti"))
        new = materialize(new.unionByName(kept), "stage")
    (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("kind", "bucket").parquet(root))


GENERATED_SCHEMA = "project string, kind string, text string, error string"


def generate_with(worklist: DataFrame, generator_factory) -> DataFrame:
    """M8: run a pluggable generator over the work list inside the tasks.

    ``worklist(project, kind, context)``; ``generator_factory()`` is called
    once per Python worker and returns ``fn(project, kind, context) -> str``.
    A failing item yields ``error`` instead of failing the job; replies are
    cleaned (S7) on the way out.  METADATA replies go through
    :func:`parse_metadata` next.
    """
    import pandas as pd

    def run(batches):
        gen = generator_factory()
        for pdf in batches:
            out = []
            for project, kind, ctx in zip(pdf["project"], pdf["kind"], pdf["context"]):
                try:
                    out.append((project, kind, gen(project, kind, ctx), None))
                except Exception as e:  # noqa: BLE001 -- per-item failure is data
                    out.append((project, kind, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["project", "kind", "text", "error"])

    raw = worklist.select("project", "kind", "context").mapInPandas(run, GENERATED_SCHEMA)
    return raw.withColumn("text", F.when(F.col("kind") == "metadata", F.col("text"))
                          .otherwise(clean_markdown(F.col("text"))))


def export_docs(docs_df: DataFrame, base_path: str) -> None:
    """S11 optional export: write each document as ``<base>/<project>/<FILE>``
    (README.md / METADATA.json / USAGE.md) from the executors with
    ``foreachPartition``.  ``base_path`` must be a folder every executor can
    write (a shared mount); each file is written to a temporary name and
    renamed, so a retried task leaves whole files only."""
    from treeline.functions import fixed

    names = dict(fixed.DOC_FILE_NAMES)

    def write(rows):
        import os
        import uuid

        for r in rows:
            folder = os.path.join(base_path, r["project"])
            os.makedirs(folder, exist_ok=True)
            target = os.path.join(folder, names.get(r["kind"], r["kind"]))
            tmp = f"{target}.{uuid.uuid4().hex}.tmp"
            with open(tmp, "w", encoding="utf-8") as fh:
                fh.write(r["text"] or "")
            os.replace(tmp, target)

    docs_df.select("project", "kind", "text").foreachPartition(write)
