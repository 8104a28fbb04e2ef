"""Bindings of the driver's generic tables to the catalog's inputs.

The driver's tables hold no repositories, so each registered query first
derives catalog-shaped inputs from them (see SURVEY §2.15):

* file tree       <- ``documents`` (project = source, content = text)
* commits / LOC   <- ``events`` (project = user_id, sha = event_id)
* remotes         <- ``pages.url``
* keyword bridge  <- distinct ``lineitem.l_orderkey`` x ``part.p_type``
* projects        <- ``customer`` (+ ``orders`` as children)
* vectors         <- ``embeddings`` (id = vec_id, project = label)

Every binding is a pure column expression over the whole table, so the
work of each query grows with its input.  The same recipes are written in
SQL in :mod:`treeline.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.io import table

EPOCH_FILES = "2024-01-01 00:00:00"
SEP = "\u001f"


def file_tree(spark: SparkSession, sf_dir: str, with_content: bool = True) -> DataFrame:
    """``documents`` as a tree of files, one project per ``source``.

    path = folder + ('.' for every 17th doc) + doc_id + suffix, where the
    folder is ``.git/`` (doc_id % 7 = 0), ``node_modules/`` (% 11), the
    project root (% 13), ``src/lib/`` (% 19) or ``src/``; the suffix cycles
    through .py .js .rs .md and none.  mtime = 2024-01-01 + doc_id minutes.
    """
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    folder = (F.when(i % 7 == 0, F.lit(".git/"))
              .when(i % 11 == 0, F.lit("node_modules/"))
              .when(i % 13 == 0, F.lit(""))
              .when(i % 19 == 0, F.lit("src/lib/"))
              .otherwise(F.lit("src/")))
    m = i % 5
    suffix = (F.when(m == 0, ".py").when(m == 1, ".js").when(m == 2, ".rs").when(m == 3, ".md").otherwise(""))
    name = F.concat(F.when(i % 17 == 0, F.lit(".")).otherwise(F.lit("")), i.cast("string"), suffix)
    cols = [
        F.col("doc_id"),
        F.col("source").alias("project"),
        F.concat(folder, name).alias("path"),
        name.alias("name"),
        F.col("n_chars").cast("long").alias("size_bytes"),
        (F.lit(EPOCH_FILES).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), i.cast("int"))).alias("modified_at"),
    ]
    if with_content:
        cols.append(F.col("text").alias("content"))
    return d.select(*cols)


# The same tree in DuckDB SQL (a CTE named ``tree``).
TREE_SQL = """tree AS (
  SELECT doc_id, source AS project,
         CASE WHEN doc_id % 7 = 0 THEN '.git/' WHEN doc_id % 11 = 0 THEN 'node_modules/'
              WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 19 = 0 THEN 'src/lib/' ELSE 'src/' END
         || CASE WHEN doc_id % 17 = 0 THEN '.' ELSE '' END || doc_id::VARCHAR
         || CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.rs' WHEN 3 THEN '.md' ELSE '' END AS path,
         CASE WHEN doc_id % 17 = 0 THEN '.' ELSE '' END || doc_id::VARCHAR
         || CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.rs' WHEN 3 THEN '.md' ELSE '' END AS name,
         n_chars AS size_bytes,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS modified_at,
         text AS content
  FROM documents)"""


def commit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as exported commit-log lines (one per event).

    sha = 40-digit hex of event_id; author = event_type ('' for errors);
    date = ts with offset +02:00 (shifted), Z or +00:00, unreadable for
    every 13th; subject = 'update: ' + props.  Every 17th line carries a
    sixth field, every 19th is blank.
    """
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    wall = F.when(i % 3 == 0, F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(2))).otherwise(F.col("ts"))
    off = F.when(i % 3 == 0, F.lit("+02:00")).when(i % 3 == 1, F.lit("Z")).otherwise(F.lit("+00:00"))
    date = F.when(i % 13 == 0, F.lit("not-a-date")).otherwise(
        F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), off))
    line = F.concat_ws(
        SEP,
        F.lpad(F.hex(i), 40, "0"),
        F.lpad(F.hex(i), 7, "0"),
        F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("event_type")),
        date,
        F.concat(F.lit("update: "), F.col("props")),
    )
    line = F.when(i % 17 == 0, F.concat(line, F.lit(SEP + "extra"))).otherwise(line)
    line = F.when(i % 19 == 0, F.lit("  ")).otherwise(line)
    return e.select(F.col("user_id").alias("project"), line.alias("value"))


COMMIT_LINES_SQL = """clines AS (
  SELECT user_id AS project,
         CASE WHEN event_id % 19 = 0 THEN '  ' ELSE
         lpad(hex(event_id), 40, '0') || chr(31) || lpad(hex(event_id), 7, '0') || chr(31) ||
         CASE WHEN event_type = 'error' THEN '' ELSE event_type END || chr(31) ||
         CASE WHEN event_id % 13 = 0 THEN 'not-a-date'
              ELSE strftime(CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 2 HOUR ELSE ts END, '%Y-%m-%dT%H:%M:%S')
                   || CASE WHEN event_id % 3 = 0 THEN '+02:00' WHEN event_id % 3 = 1 THEN 'Z' ELSE '+00:00' END END
         || chr(31) || 'update: ' || props
         || CASE WHEN event_id % 17 = 0 THEN chr(31) || 'extra' ELSE '' END END AS value
  FROM events)"""

# Parsed commits in SQL: five fields, empty author -> NULL, offset applied.
COMMITS_SQL = COMMIT_LINES_SQL + r""",
cparts AS (SELECT project, string_split(value, chr(31)) AS p FROM clines WHERE trim(value) <> ''),
commits AS (
  SELECT project, p[1] AS sha, p[2] AS short_sha, nullif(p[3], '') AS author,
         CASE WHEN regexp_matches(p[4], '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$')
              THEN try_strptime(substr(p[4], 1, 19), '%Y-%m-%dT%H:%M:%S')
                   - CASE WHEN regexp_extract(p[4], '([+-])\d{2}:?\d{2}$', 1) = '-' THEN -1 ELSE 1 END
                     * to_minutes(coalesce(try_cast(regexp_extract(p[4], '[+-](\d{2}):?\d{2}$', 1) AS INTEGER), 0) * 60
                                  + coalesce(try_cast(regexp_extract(p[4], '[+-]\d{2}:?(\d{2})$', 1) AS INTEGER), 0))
         END AS committed_at,
         p[5] AS message
  FROM cparts WHERE len(p) = 5)"""


def loc_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as scan-time LOC snapshots (project = user_id)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("project_id"),
        F.col("event_id").alias("snapshot_id"),
        F.col("ts").alias("recorded_at"),
        F.floor(F.col("value") * 100).cast("long").alias("lines_of_code"),
        (F.col("event_id") % 97).alias("file_count"),
    )


SNAPSHOTS_SQL = """snaps AS (
  SELECT user_id AS project_id, event_id AS snapshot_id, ts AS recorded_at,
         floor(value * 100)::BIGINT AS lines_of_code, event_id % 97 AS file_count
  FROM events)"""


def keyword_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated (project_id, keyword): a customer's orders' part types and
    brands, lower-cased and trimmed."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    kw = F.explode(F.array(F.lower(F.trim(F.col("p_type"))), F.lower(F.trim(F.col("p_brand")))))
    return j.select(F.col("o_custkey").alias("project_id"), kw.alias("keyword")).distinct()


BRIDGE_SQL = """bridge AS (
  SELECT DISTINCT o.o_custkey AS project_id, unnest([lower(trim(p.p_type)), lower(trim(p.p_brand))]) AS keyword
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey)"""


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as the modules of the customer projects."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("module_id"),
        F.col("o_custkey").alias("project_id"),
        F.concat(F.lit("mod"), F.col("o_orderkey").cast("string")).alias("name"),
        F.concat(F.lit("pkg/"), F.col("o_orderpriority"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("Status "), F.col("o_orderstatus"))).otherwise(F.lit("")).alias("description"),
    )


MODULES_SQL = """mods AS (
  SELECT o_orderkey AS module_id, o_custkey AS project_id, 'mod' || o_orderkey::VARCHAR AS name,
         'pkg/' || o_orderpriority || '/' || o_orderkey::VARCHAR AS path,
         CASE WHEN o_orderstatus <> 'P' THEN 'Status ' || o_orderstatus ELSE '' END AS description
  FROM orders)"""


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as catalog projects (with some nulls on purpose)."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    ki = k.cast("int")
    return c.select(
        k.alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("/code/"), F.col("c_name")).alias("path"),
        F.when(k % 9 == 0, F.lit(None).cast("string")).otherwise(F.lower(F.col("c_mktsegment"))).alias("primary_language"),
        F.when(k % 23 == 0, F.lit(None).cast("long")).otherwise(F.floor(F.col("c_acctbal") * 100).cast("long")).alias("lines_of_code"),
        (F.col("c_nationkey").cast("long") * 10 + k % 10).alias("file_count"),
        (F.lit("2020-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(ki)).alias("project_created_at"),
        F.when(k % 31 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(
            F.lit("2023-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), ki % 5000)).alias("last_code_modified_at"),
        (F.lit("2024-06-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), ki)).alias("scanned_at"),
        F.concat(F.lit("Segment "), F.col("c_mktsegment"), F.lit(" account ")).alias("short_description"),
        (k % 4 != 0).alias("is_git_repo"),
        F.when(k % 2 == 0, F.concat(F.lit("Readme of "), F.col("c_name"))).alias("readme_content"),
        F.when(k % 3 == 0, F.concat(F.lit('{"name": "'), F.col("c_name"), F.lit('"}'))).alias("metadata_json"),
        F.col("c_nationkey").alias("nation"),
    )


PROJECTS_SQL = """proj AS (
  SELECT c_custkey AS id, c_name AS name, '/code/' || c_name AS path,
         CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE lower(c_mktsegment) END AS primary_language,
         CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE floor(c_acctbal * 100)::BIGINT END AS lines_of_code,
         c_nationkey::BIGINT * 10 + c_custkey % 10 AS file_count,
         TIMESTAMP '2020-01-01 00:00:00' + to_days(c_custkey::INTEGER) AS project_created_at,
         CASE WHEN c_custkey % 31 = 0 THEN NULL
              ELSE TIMESTAMP '2023-01-01 00:00:00' + to_hours((c_custkey % 5000)::INTEGER) END AS last_code_modified_at,
         TIMESTAMP '2024-06-01 00:00:00' + to_minutes(c_custkey::INTEGER) AS scanned_at,
         'Segment ' || c_mktsegment || ' account ' AS short_description,
         c_custkey % 4 <> 0 AS is_git_repo,
         CASE WHEN c_custkey % 2 = 0 THEN 'Readme of ' || c_name END AS readme_content,
         CASE WHEN c_custkey % 3 = 0 THEN '{"name": "' || c_name || '"}' END AS metadata_json,
         c_nationkey AS nation
  FROM customer)"""


def catalog_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored catalog: customers with custkey % 3 <> 0; customers 2k and
    2k+1 share the remote p<k> unless custkey % 4 = 0 (no remote)."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.where(k % 3 != 0).select(
        k.alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("/code/"), F.col("c_name")).alias("path"),
        F.when(k % 4 != 0, F.concat(F.lit("git@github.com:org/p"), F.floor(k / 2).cast("string"), F.lit(".git"))).alias("git_remote_url"),
        (F.lit("2024-06-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), k.cast("int"))).alias("scanned_at"),
        F.floor(F.col("c_acctbal") * 100).cast("long").alias("lines_of_code"),
    )


def disk_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders on disk: customers with custkey % 5 <> 0 or % 3 = 0 (so each
    customer is in the catalog, on disk or in both), renamed when
    custkey % 7 = 0; no eligible file when % 11 = 0; mtime equal to the
    last scan when % 13 = 0, else one hour later (even) or earlier (odd)."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = F.when(k % 7 == 0, F.concat(F.lit("Renamed#"), k.cast("string"))).otherwise(F.col("c_name"))
    base = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), k.cast("int"))
    mtime = (F.when(k % 11 == 0, F.lit(None).cast("timestamp_ntz"))
             .when(k % 13 == 0, base)
             .when(k % 2 == 0, base + F.make_dt_interval(F.lit(0), F.lit(1)))
             .otherwise(base - F.make_dt_interval(F.lit(0), F.lit(1))))
    return c.where((k % 5 != 0) | (k % 3 == 0)).select(
        k.alias("new_id"), name.alias("name"), F.concat(F.lit("/code/"), name).alias("path"),
        F.when(k % 4 != 0, F.concat(F.lit("git@github.com:org/p"), F.floor(k / 2).cast("string"), F.lit(".git"))).alias("remote"),
        mtime.alias("latest_mtime"),
        (F.floor(F.col("c_acctbal") * 100).cast("long") + k % 100).alias("lines_of_code"),
    )


CATALOG_SQL = """before AS (
  SELECT c_custkey AS id, c_name AS name, '/code/' || c_name AS path,
         CASE WHEN c_custkey % 4 <> 0 THEN 'git@github.com:org/p' || (c_custkey // 2)::VARCHAR || '.git' END AS git_remote_url,
         TIMESTAMP '2024-06-01 00:00:00' + to_minutes(c_custkey::INTEGER) AS scanned_at,
         floor(c_acctbal * 100)::BIGINT AS lines_of_code
  FROM customer WHERE c_custkey % 3 <> 0),
disk AS (
  SELECT c_custkey AS new_id, n AS name, '/code/' || n AS path,
         CASE WHEN c_custkey % 4 <> 0 THEN 'git@github.com:org/p' || (c_custkey // 2)::VARCHAR || '.git' END AS remote,
         CASE WHEN c_custkey % 11 = 0 THEN NULL
              WHEN c_custkey % 13 = 0 THEN b
              WHEN c_custkey % 2 = 0 THEN b + INTERVAL 1 HOUR
              ELSE b - INTERVAL 1 HOUR END AS latest_mtime,
         floor(c_acctbal * 100)::BIGINT + c_custkey % 100 AS lines_of_code
  FROM (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN 'Renamed#' || c_custkey::VARCHAR ELSE c_name END AS n,
               TIMESTAMP '2024-06-01 00:00:00' + to_minutes(c_custkey::INTEGER) AS b
        FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 3 = 0)),
stale AS (SELECT * FROM before WHERE path NOT IN (SELECT path FROM disk)),
s_pick AS (SELECT git_remote_url AS remote, max(id) AS id FROM stale WHERE git_remote_url IS NOT NULL GROUP BY 1),
d_pick AS (SELECT remote, min(name) AS new_name FROM disk
           WHERE remote IS NOT NULL AND name NOT IN (SELECT name FROM before) GROUP BY 1),
renames AS (
  SELECT s.id, b.name AS old_name, d.new_name, '/code/' || d.new_name AS new_path, s.remote
  FROM s_pick s JOIN d_pick d ON s.remote = d.remote JOIN before b ON b.id = s.id),
orphans AS (SELECT * FROM stale WHERE id NOT IN (SELECT id FROM renames)),
renamed AS (
  SELECT b.id, coalesce(r.new_name, b.name) AS name, coalesce(r.new_path, b.path) AS path,
         b.git_remote_url, b.scanned_at, b.lines_of_code
  FROM before b LEFT JOIN renames r ON b.id = r.id WHERE b.id NOT IN (SELECT id FROM orphans)),
changed AS (
  SELECT d.name, d.path, d.latest_mtime, r.scanned_at, r.id IS NULL AS is_new
  FROM disk d LEFT JOIN renamed r ON d.name = r.name
  WHERE d.latest_mtime IS NOT NULL AND (r.scanned_at IS NULL OR d.latest_mtime > r.scanned_at))"""
