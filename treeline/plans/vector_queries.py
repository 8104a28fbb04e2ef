"""Registered vector and index-maintenance queries (X3, X4, X5 LSH, X7,
P9, P12, A14, X9) over ``embeddings`` and ``documents``.

Vector binding: id = vec_id, project_id = label, kind = 'module' for
every 4th vector, 'project' otherwise; the query vector is vec_id 0.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.io import table
from treeline.operators import search, segments, text_index, vectors
from treeline.plans import oracle
from treeline.plans.registry import register
from treeline.plans.standins import BRIDGE_SQL, PROJECTS_SQL, keyword_bridge, projects
from treeline.session import materialize, scratch_path

VEC_SQL = """vecs AS (
  SELECT vec_id AS id, embedding, label AS project_id,
         CASE WHEN vec_id % 4 = 0 THEN 'module' ELSE 'project' END AS kind
  FROM embeddings),
q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id = 0)"""


def _dist_sql(filter_sql: str, k: int) -> str:
    return f""",
d AS (
  SELECT q.query_id, v.id,
         list_sum(list_transform(range(1, len(v.embedding) + 1),
                  lambda i: (v.embedding[i]::DOUBLE - q.qv[i]::DOUBLE) * (v.embedding[i]::DOUBLE - q.qv[i]::DOUBLE))) AS distance
  FROM vecs v, q WHERE {filter_sql}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM d)
SELECT query_id, id, round(distance, 6) AS distance, round(1.0 / (1.0 + distance), 6) AS score, rank FROM r WHERE rank <= {k}"""


def _vecs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("project_id"),
                    F.when(F.col("vec_id") % 4 == 0, F.lit("module")).otherwise(F.lit("project")).alias("kind"))


def _query(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def _out(df):
    return df.select("query_id", "id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "rank")


@register("x7_modules", "WITH " + VEC_SQL + _dist_sql("v.kind = 'module' AND v.project_id = 1", 10))
def x7_modules(spark, sf_dir):
    return _out(vectors.search_modules(_vecs(spark, sf_dir), _query(spark, sf_dir), 10, _names(spark, sf_dir), "group 1"))


def _names(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("project_id")).distinct().withColumn("name", F.concat(F.lit("group "), F.col("project_id").cast("string")))


@register("x7_unknown_project", "WITH " + VEC_SQL + _dist_sql("v.kind = 'module'", 10))
def x7_unknown_project(spark, sf_dir):
    return _out(vectors.search_modules(_vecs(spark, sf_dir), _query(spark, sf_dir), 10, _names(spark, sf_dir), "no such group"))


@register("p12_keyword", "WITH " + VEC_SQL + _dist_sql("v.id % 3 = 0", 10))
def p12_keyword(spark, sf_dir):
    kw = F.concat(F.lit("all,k"), (F.col("id") % 3).cast("string"))
    return _out(vectors.knn(vectors.filter_vectors(_vecs(spark, sf_dir).withColumn("meta_keywords", kw), "k0"), _query(spark, sf_dir), 10))


@register("p12_filtered_knn", "WITH " + VEC_SQL + _dist_sql("v.kind = 'project' AND v.project_id = 2", 10))
def p12_filtered_knn(spark, sf_dir):
    v = _vecs(spark, sf_dir).where((F.col("kind") == "project") & (F.col("project_id") == 2))
    return _out(vectors.knn(v, _query(spark, sf_dir), 10))


@register("a14_vector_counts", "WITH " + VEC_SQL + "\nSELECT kind, count(*)::BIGINT AS n_vectors FROM vecs GROUP BY kind")
def a14_vector_counts(spark, sf_dir):
    return vectors.collection_sizes(_vecs(spark, sf_dir))


@register("x4_vector_upsert", "WITH " + VEC_SQL + """,
old AS (SELECT id, kind, embedding FROM vecs WHERE id % 5 <> 0 OR id % 3 <> 0),
new AS (SELECT id, kind, list_transform(embedding, lambda x: (x * 2)::FLOAT) AS embedding FROM vecs WHERE id % 3 = 0),
u AS (SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new)
SELECT id, kind, len(embedding)::INTEGER AS dims, round(embedding[1]::DOUBLE, 6) AS first_value FROM u""")
def x4_vector_upsert(spark, sf_dir):
    v = _vecs(spark, sf_dir)
    old = v.where((F.col("id") % 5 != 0) | (F.col("id") % 3 != 0)).select("id", "kind", "embedding")
    new = v.where(F.col("id") % 3 == 0).select(
        "id", "kind", F.transform("embedding", lambda x: (x * 2).cast("float")).alias("embedding"))
    u = vectors.upsert(old, new, ["id"])
    return u.select("id", "kind", F.size("embedding").alias("dims"),
                    F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first_value"))


@register("f9_vector_rows", "WITH " + PROJECTS_SQL + ",\n" + BRIDGE_SQL + """,
kw AS (SELECT project_id, list(keyword ORDER BY keyword) AS k FROM bridge GROUP BY 1),
t AS (SELECT id, name, short_description, coalesce(k, []) AS k,
             concat_ws('. ', name, nullif(short_description, ''), CASE WHEN len(coalesce(k, [])) > 0 THEN 'Keywords: ' || array_to_string(k, ', ') END,
                       nullif(substr(readme_content, 1, 1000), '')) AS text
      FROM proj LEFT JOIN kw ON proj.id = kw.project_id)
SELECT id, text, name AS meta_name, substr(short_description, 1, 500) AS meta_short_description, array_to_string(k[1:20], ',') AS meta_keywords,
       substr(text, 1, 5000) AS document FROM t""")
def f9_vector_rows(spark, sf_dir):
    """The text embedded for each project, and its metadata."""
    kw = keyword_bridge(spark, sf_dir).groupBy(F.col("project_id").alias("id")).agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    p = projects(spark, sf_dir).join(kw, "id", "left").withColumn("long_description", F.lit(None).cast("string"))
    return vectors.project_vector_rows(p).drop("kind", "project_id")


@register("x3_embed", r"""
WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS token FROM documents),
n AS (SELECT doc_id, token, count(*) AS n, md5(token) AS h FROM t GROUP BY ALL),
d AS (SELECT doc_id, n, (4096 * (instr('0123456789abcdef', h[1]) - 1) + 256 * (instr('0123456789abcdef', h[2]) - 1)
        + 16 * (instr('0123456789abcdef', h[3]) - 1) + instr('0123456789abcdef', h[4]) - 1) % 384 AS bucket FROM n),
f AS (SELECT doc_id, bucket::INTEGER AS bucket, sum(n)::DOUBLE AS tf FROM d GROUP BY ALL)
SELECT doc_id, bucket, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)), 6) AS weight FROM f""")
def x3_embed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return vectors.hash_features(d, ["doc_id"], "text").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@register("x4_refresh", "WITH " + PROJECTS_SQL + ",\n" + BRIDGE_SQL + r""",
kw AS (SELECT project_id, list(keyword ORDER BY keyword) AS k FROM bridge GROUP BY 1),
p2 AS (SELECT id, name, readme_content, CASE WHEN id % 3 = 0 THEN short_description ELSE 'old ' || coalesce(short_description, '') END AS sd FROM proj),
x AS (SELECT id, concat_ws('. ', name, nullif(sd, ''), CASE WHEN len(coalesce(k, [])) > 0 THEN 'Keywords: ' || array_to_string(k, ', ') END,
             nullif(substr(readme_content, 1, 1000), '')) AS text FROM p2 LEFT JOIN kw ON p2.id = kw.project_id),
t AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS token FROM x),
n AS (SELECT id, token, count(*) AS n, md5(token) AS h FROM t GROUP BY ALL),
d AS (SELECT id, n, (4096 * (instr('0123456789abcdef', h[1]) - 1) + 256 * (instr('0123456789abcdef', h[2]) - 1)
        + 16 * (instr('0123456789abcdef', h[3]) - 1) + instr('0123456789abcdef', h[4]) - 1) % 384 AS bucket FROM n),
f AS (SELECT id, bucket::INTEGER AS bucket, sum(n)::DOUBLE AS tf FROM d GROUP BY ALL)
SELECT id, bucket, round((tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)))::FLOAT::DOUBLE, 6) AS weight FROM f""")
def x4_refresh(spark, sf_dir):
    """F9, X3 and X4 in a row: vectors of every project's older text, then the
    texts that changed (every third) are embedded anew and replace theirs;
    the collection as (bucket, weight) of its non-zero places."""
    kw = keyword_bridge(spark, sf_dir).groupBy(F.col("project_id").alias("id")).agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    now = projects(spark, sf_dir).join(kw, "id", "left").withColumn("long_description", F.lit(None).cast("string"))
    before = now.withColumn("short_description", F.concat(F.lit("old "), F.coalesce("short_description", F.lit(""))))
    first = materialize(vectors.refresh_vectors(None, vectors.project_vector_rows(before)))
    v = vectors.refresh_vectors(first, vectors.project_vector_rows(now.where(F.col("id") % 3 == 0)))
    each = v.select("id", F.posexplode("embedding").alias("bucket", "weight")).where("weight <> 0")
    return each.select("id", "bucket", F.round(F.col("weight").cast("double"), 6).alias("weight"))


@register("j10_module_rows", "WITH " + VEC_SQL + _dist_sql("v.kind = 'module' AND v.project_id = 1", 10).replace("\nSELECT query_id", ",\nhit AS (SELECT query_id") + """)
SELECT hit.rank, hit.id, hit.score, d.source, d.lang, length(d.text)::INTEGER AS chars FROM hit JOIN documents d ON d.doc_id = hit.id""")
def j10_module_rows(spark, sf_dir):
    """Module hits with the rows of the modules they name."""
    hits = vectors.search_modules(_vecs(spark, sf_dir), _query(spark, sf_dir), 10, _names(spark, sf_dir), "group 1")
    modules = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang", F.length("text").alias("chars"))
    return search.attach(hits, modules).select("rank", "id", F.round("score", 6).alias("score"), "source", "lang", "chars")


@register("x5_lsh_recall")
def x5_lsh_recall(spark, sf_dir):
    """Recall@10 of LSH candidates against the exact neighbours; queries are
    the vectors whose id 20 divides, the index holds every vector."""
    e = table(spark, sf_dir, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), "embedding")
    q = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    exact = vectors.knn_blocks(v, q, 10).select("query_id", "id")
    approx = vectors.lsh_candidates(v, q, 10).select("query_id", "id", F.lit(1).alias("hit"))
    j = exact.join(approx, ["query_id", "id"], "left")
    return j.groupBy("query_id").agg((F.count("hit") / F.lit(10.0)).alias("recall"))


# ----------------------------------------------------------- index upkeep

def _index_state(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    h = F.when(F.col("doc_id") % 10 == 0, F.md5(F.concat(F.col("text"), F.lit(" stale")))).otherwise(F.md5("text"))
    return d.where(F.col("doc_id") % 4 != 0).select("doc_id", h.alias("content_hash"))


@register("p9_needs_index", """
WITH st AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN md5(text || ' stale') ELSE md5(text) END AS h
            FROM documents WHERE doc_id % 4 <> 0)
SELECT d.doc_id, md5(d.text) AS content_hash, st.h IS NULL OR st.h <> md5(d.text) AS needs_index
FROM documents d LEFT JOIN st USING (doc_id)""")
def p9_needs_index(spark, sf_dir):
    return text_index.needs_index(table(spark, sf_dir, "documents"), _index_state(spark, sf_dir))


@register("x9_incremental_index", oracle.ORACLE["x1_postings"])
def x9_incremental_index(spark, sf_dir):
    """An index of the previous texts, refreshed: documents that are new or
    whose hash is stale go into one more segment; must equal a rebuild."""
    d = table(spark, sf_dir, "documents")
    state = _index_state(spark, sf_dir)
    previous = (d.join(state.select("doc_id"), "doc_id", "left_semi")
                .withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat(F.col("text"), F.lit(" stale")))
                            .otherwise(F.col("text"))))
    path = scratch_path(spark, "stage-index")
    segments.add_segment(spark, path, previous.select("doc_id", "text"))
    segments.refresh(spark, path, d.select("doc_id", "text"))
    return segments.current(spark, path, "postings").select("doc_id", "field", "pos", "token", "dl")
