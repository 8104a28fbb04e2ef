"""Catalog reads: browse, lists, lookups, facets, totals (O1-O5, O9, P5-P8,
A5-A8, J1, J11).

``projects`` has at least ``id, name, primary_language, lines_of_code,
file_count, last_code_modified_at, project_created_at, scanned_at``;
``bridge`` is the deduplicated ``(project_id, keyword)`` table; ``modules``
has ``(module_id, project_id, name, path, description)``.

Facets are one grouped aggregation each (partial aggregation before the
shuffle keeps a hot keyword cheap).  Paged reads add a unique tie-break so
every page is deterministic, and use ``offset/limit`` (TakeOrderedAndProject).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import fixed

# Browse sort keys: name ascending; the others newest / largest first.
SORTS = {
    "name": ("name", "asc"),
    "recent": ("last_code_modified_at", "desc"),
    "created": ("project_created_at", "desc"),
    "loc": ("lines_of_code", "desc"),
    "files": ("file_count", "desc"),
}


def _sort_key(sort: str) -> Column:
    col, direction = SORTS.get(sort, SORTS["name"])
    return F.asc(col) if direction == "asc" else F.desc_nulls_last(col)


def filter_language(projects: DataFrame, language: str | None) -> DataFrame:
    """P5: exact primary-language filter (no filter when None/empty)."""
    if not language:
        return projects
    return projects.where(F.col("primary_language") == language)


def filter_keyword(projects: DataFrame, bridge: DataFrame, keyword: str | None) -> DataFrame:
    """Projects carrying the keyword (lower-cased, exact) -- semi join."""
    if not keyword:
        return projects
    hits = bridge.where(F.col("keyword") == keyword.lower()).select(F.col("project_id").alias("id"))
    return projects.join(hits, "id", "left_semi")


def browse(projects: DataFrame, bridge: DataFrame | None = None, language: str | None = None,
           keyword: str | None = None, sort: str = "name", page: int = 1,
           per_page: int = fixed.BROWSE_PAGE_SIZE) -> DataFrame:
    """O1: one page of the filtered, sorted catalog with ``total`` and
    ``total_pages`` columns (unknown sort key -> name).  A page past the end
    is one row of nulls with the totals."""
    q = filter_language(projects, language)
    if keyword and bridge is not None:
        q = filter_keyword(q, bridge, keyword)
    order = [_sort_key(sort), F.asc("name"), F.asc("id")]
    offset = max(page - 1, 0) * per_page
    page_rows = q.orderBy(*order).offset(offset).limit(per_page)
    total = q.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "total_pages", F.floor((F.col("total") + per_page - 1) / per_page).cast("long"))
    # the totals come first: a page past the end has no rows, but still its totals
    return total.join(F.broadcast(page_rows), F.lit(True), "left").select(*projects.columns, "total", "total_pages")


def list_projects(projects: DataFrame, limit: int = 50, offset: int = 0, language: str | None = None,
                  bridge: DataFrame | None = None, keyword: str | None = None) -> DataFrame:
    """O2: API list by name with limit and offset, filtered by language and keyword."""
    if not 0 < limit <= fixed.LIST_MAX_LIMIT:
        raise ValueError(f"limit must be 1 to {fixed.LIST_MAX_LIMIT}")
    q = filter_language(projects, language)
    if keyword and bridge is not None:
        q = filter_keyword(q, bridge, keyword)
    return q.orderBy(F.asc("name"), F.asc("id")).offset(offset).limit(limit)


def keyword_facet(bridge: DataFrame) -> DataFrame:
    """A5: projects per keyword (derived, never stored), keywords with > 0 only."""
    return (bridge.select("project_id", "keyword").dropDuplicates()
            .groupBy("keyword").agg(F.count(F.lit(1)).alias("project_count")))


def top_keywords(bridge: DataFrame, k: int = 100) -> DataFrame:
    """O3: most used keywords, count desc then name."""
    return keyword_facet(bridge).orderBy(F.desc("project_count"), F.asc("keyword")).limit(k)


def language_facet(projects: DataFrame) -> DataFrame:
    """Projects per non-null primary language."""
    return (projects.where(F.col("primary_language").isNotNull())
            .groupBy("primary_language").agg(F.count(F.lit(1)).alias("project_count")))


def top_languages(projects: DataFrame, k: int | None = None) -> DataFrame:
    """Language facet, count desc then name, first ``k`` (all when None)."""
    f = language_facet(projects).orderBy(F.desc("project_count"), F.asc("primary_language"))
    return f.limit(k) if k else f


def recent(projects: DataFrame, k: int = 10) -> DataFrame:
    """Most recently scanned."""
    return projects.orderBy(F.desc_nulls_last("scanned_at"), F.asc("id")).limit(k)


def lookup(projects: DataFrame, name: str) -> DataFrame:
    """Point lookup by name with README fallback text."""
    return (projects.where(F.col("name") == name)
            .withColumn("readme", F.coalesce(F.col("readme_content"), F.lit(fixed.NO_README_TEXT))))


def like_search(projects: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """Case-insensitive substring match on name or short description."""
    needle = F.lit(q.lower())
    cond = F.contains(F.lower(F.col("name")), needle) | F.contains(
        F.lower(F.coalesce(F.col("short_description"), F.lit(""))), needle)
    return projects.where(cond).orderBy(F.asc("name"), F.asc("id")).limit(limit)


def keyword_join(projects: DataFrame, bridge: DataFrame) -> DataFrame:
    """Projects x bridge x keywords (inner); a keyword's id is its hash, so the join never groups by keyword."""
    return (projects.select("id", "name").join(bridge.withColumnRenamed("project_id", "id"), "id")
            .withColumn("keyword_id", F.xxhash64("keyword")))


def totals(projects: DataFrame, modules: DataFrame, bridge: DataFrame) -> DataFrame:
    """A7 (+P11): catalog totals in one row."""
    p = projects.agg(
        F.count(F.lit(1)).alias("projects"),
        F.coalesce(F.sum("lines_of_code"), F.lit(0)).cast("long").alias("total_loc"),
        F.count_if(F.col("is_git_repo")).alias("git_repos"),
        F.count("readme_content").alias("with_readme"),
        F.count("metadata_json").alias("with_metadata"),
    )
    m = modules.agg(F.count(F.lit(1)).alias("modules"))
    k = bridge.agg(F.countDistinct("keyword").alias("keywords"))
    return p.crossJoin(m).crossJoin(k)


def scan_summary(projects: DataFrame) -> DataFrame:
    """Projects, git repositories, total LOC of a scan."""
    return projects.agg(
        F.count(F.lit(1)).alias("projects"),
        F.count_if(F.col("is_git_repo")).alias("git_repos"),
        F.coalesce(F.sum("lines_of_code"), F.lit(0)).cast("long").alias("total_loc"),
    )


PROJECT_FIELDS = ("path", "short_description", "long_description", "primary_language", "languages", "frameworks",
                  "is_git_repo", "github_name", "git_remote_url", "default_branch", "last_commit_at", "file_count", "lines_of_code")


def project_children(projects: DataFrame, bridge: DataFrame, modules: DataFrame) -> DataFrame:
    """All keywords and all modules of every project as rows (id, kind,
    child_id, name, path, description); nothing is cut or collected."""
    ids = projects.select("id")
    kw = bridge.select(F.col("project_id").alias("id"), F.lit("keyword").alias("kind"), F.lit(None).cast("long").alias("child_id"),
                       F.col("keyword").alias("name"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("description"))
    mods = modules.select(F.col("project_id").alias("id"), F.lit("module").alias("kind"), F.col("module_id").cast("long").alias("child_id"),
                          "name", "path", "description")
    return kw.unionByName(mods).join(ids, "id", "left_semi")


def project_documents(projects: DataFrame, bridge: DataFrame, modules: DataFrame, ids: list[int]) -> DataFrame:
    """J11 response: the complete documents of the asked projects (a request
    names them), keywords sorted, every module with path and description
    ordered by path; PROJECT_FIELDS that the catalog lacks are null."""
    from treeline.functions.exprs import github_url

    some = projects.where(F.col("id").isin(list(ids)))
    child = project_children(some, bridge, modules)
    kws = child.where("kind = 'keyword'").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("keywords"))
    mods = child.where("kind = 'module'").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("path", "child_id", "name", "description"))).alias("modules"))
    have = set(projects.columns)
    out = some.join(kws, "id", "left").join(mods, "id", "left")
    fields = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in PROJECT_FIELDS]
    url = github_url(F.col("github_name")) if "github_name" in have else F.lit(None).cast("string")
    return out.select("id", "name", *fields, url.alias("github_url"),
                      F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
                      F.transform(F.coalesce("modules", F.array()), lambda m: F.struct(m["name"], m["path"], m["description"])).alias("modules"))
