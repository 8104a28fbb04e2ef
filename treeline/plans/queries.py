"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator key of SURVEY §2.  Each binds the driver tables (through
:mod:`treeline.plans.standins`) to the library operators; the equivalent
DuckDB SQL lives in :mod:`treeline.plans.oracle` with identical column
names.  Scores and other doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.io import table
from treeline.operators import search, segments, text_index, vectors
from treeline.plans import oracle
from treeline.plans.registry import register
from treeline.plans.standins import PROJECTS_SQL, projects
from treeline.plans.stored import document_index
from treeline.session import scratch_path

# Driver-binding parameters (fixed for the registered queries).
PHRASE = "the on"
HYBRID_LIMIT = 10
KNN_K = 10
QUERY_VEC_ID = 0


def r6(c):
    return F.round(c, 6)


# --------------------------------------------------------------------- search

def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@register("x1_postings", oracle.ORACLE["x1_postings"])
def x1_postings(spark, sf_dir):
    return text_index.build_postings(_docs(spark, sf_dir))


@register("x2_phrase_bm25", oracle.ORACLE["x2_phrase_bm25"])
def x2_phrase_bm25(spark, sf_dir):
    """Phrase search through the stored index; the text isn't read."""
    hits = _phrase_hits(spark, sf_dir, 20)
    return hits.select("doc_id", "tf", "dl", r6(F.col("score")).alias("score"))


@register("x2_scan", oracle.ORACLE["x2_phrase_bm25"])
def x2_scan(spark, sf_dir):
    """The same without an index: one regex pass over the text."""
    hits = text_index.phrase_search_scan(_docs(spark, sf_dir), PHRASE, limit=20)
    return hits.select("doc_id", "tf", "dl", r6(F.col("score")).alias("score"))


def _phrase_hits(spark, sf_dir, limit):
    return segments.phrase_search(spark, document_index(spark, sf_dir), PHRASE, limit)


def _semantic_hits(spark, sf_dir, k):
    emb = table(spark, sf_dir, "embeddings")
    q = emb.where(F.col("vec_id") == QUERY_VEC_ID).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return vectors.knn(emb, q, k, id_col="vec_id", vec_col="embedding")


@register("x5_knn", oracle.ORACLE["x5_knn"])
def x5_knn(spark, sf_dir):
    res = _semantic_hits(spark, sf_dir, KNN_K)
    return res.select("query_id", "id", r6(F.col("distance")).alias("distance"),
                      r6(F.col("score")).alias("score"), "rank")


def hybrid_plan(spark, sf_dir, limit=HYBRID_LIMIT, with_semantic=True):
    docs = table(spark, sf_dir, "documents")
    fts = _phrase_hits(spark, sf_dir, 2 * limit).select(F.col("doc_id").alias("id"), "score")
    sem = None
    if with_semantic:
        sem = _semantic_hits(spark, sf_dir, 2 * limit).select("id", "score")
        sem = search.resolve_semantic(sem, docs.select(F.col("doc_id").alias("id")))
    return search.hybrid(fts, sem, limit)


@register("x6_hybrid", oracle.ORACLE["x6_hybrid"])
def x6_hybrid(spark, sf_dir):
    res = hybrid_plan(spark, sf_dir)
    return res.select("id", r6(F.col("fts_score")).alias("fts_score"), r6(F.col("sem_score")).alias("sem_score"),
                      r6(F.col("score")).alias("score"))


@register("x11_hybrid_no_vectors", oracle.ORACLE["x11_hybrid_no_vectors"])
def x11_hybrid_no_vectors(spark, sf_dir):
    res = hybrid_plan(spark, sf_dir, with_semantic=False)
    return res.select("id", r6(F.col("fts_score")).alias("fts_score"), r6(F.col("sem_score")).alias("sem_score"),
                      r6(F.col("score")).alias("score"))


@register("j2_attach", oracle.ORACLE["x6_hybrid"].replace("SELECT id, round(fts_score, 6) AS fts_score, round(sem_score, 6) AS sem_score, round(score, 6) AS score FROM h",
          "SELECT h.id, round(h.score, 6) AS score, d.source, d.lang FROM h JOIN documents d ON d.doc_id = h.id"))
def j2_attach(spark, sf_dir):
    """Catalog rows attached to the hybrid hits."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    return search.attach(hybrid_plan(spark, sf_dir), rows).select("id", r6(F.col("score")).alias("score"), "source", "lang")


@register("x2_indexed", oracle.ORACLE["x2_phrase_bm25"])
def x2_indexed(spark, sf_dir):
    """The same search through an index that grew in four segments, which were then merged into one."""
    path = scratch_path(spark, "stage-index")
    for part in range(4):
        segments.add_segment(spark, path, _docs(spark, sf_dir).where(F.pmod("doc_id", F.lit(4)) == part))
    segments.merge(spark, path)
    hits = segments.phrase_search(spark, path, PHRASE, 20)
    return hits.select("doc_id", "tf", "dl", r6(F.col("score")).alias("score"))


_FIELDS = ("name", "short_description", "readme_content", "metadata_json", "primary_language")


@register("x1_five_fields", "WITH " + PROJECTS_SQL + "," + r"""
f AS (SELECT id, field, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t
      FROM (""" + " UNION ALL ".join(f"SELECT id, {k} AS field, {c} AS text FROM proj" for k, c in enumerate(_FIELDS)) + r""")),
n AS (SELECT id, sum(len(t))::BIGINT AS dl FROM f GROUP BY id)
SELECT f.id AS doc_id, field::INTEGER AS field, unnest(range(len(t)))::INTEGER AS pos, unnest(t) AS token, n.dl FROM f JOIN n ON f.id = n.id""")
def x1_five_fields(spark, sf_dir):
    return text_index.build_postings(projects(spark, sf_dir), "id", _FIELDS)


@register("u1_union_ids", oracle._bm25_top(40) + ",\n" + oracle._KNN + """
SELECT doc_id AS id FROM fts UNION SELECT id FROM knn_r WHERE rank <= 40""")
def u1_union_ids(spark, sf_dir):
    fts = _phrase_hits(spark, sf_dir, 40).select(F.col("doc_id").alias("id"))
    sem = _semantic_hits(spark, sf_dir, 40).select("id")
    return search.union_ids(fts, sem)


@register("u2_known_ids", "WITH " + oracle._KNN + """
SELECT id FROM knn_r WHERE rank <= 40 AND id IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)""")
def u2_known_ids(spark, sf_dir):
    sem = _semantic_hits(spark, sf_dir, 40).select("id")
    catalog = table(spark, sf_dir, "documents").where(F.col("doc_id") % 3 != 0).select(F.col("doc_id").alias("id"))
    return search.known_ids(sem, catalog)


@register("w1_rank_score", oracle._bm25_top(30) + """,
r AS (SELECT doc_id, (row_number() OVER (ORDER BY score DESC, doc_id) - 1)::INTEGER AS rank,
             count(*) OVER () AS n FROM fts)
SELECT doc_id AS id, rank, round(1.0 - rank / greatest(n, 1), 6) AS rank_score,
       round(1.0 - rank / 30.0, 6) AS cli_rank_score FROM r""")
def w1_rank_score(spark, sf_dir):
    hits = _phrase_hits(spark, sf_dir, 30).select(F.col("doc_id").alias("id"), "score")
    api = text_index.rank_scores(hits, [F.desc("score"), F.asc("id")])
    cli = F.lit(1.0) - F.col("rank") / F.lit(30.0)
    return api.select("id", "rank", r6(F.col("rank_score")).alias("rank_score"), r6(cli).alias("cli_rank_score"))


@register("x2_stemmed")
def x2_stemmed(spark, sf_dir):
    """Phrase BM25 with the stemming tokenizer; no DuckDB equivalent here
    (its full-text extension is not available), checked by tests."""
    hits = text_index.stemmed_phrase_search(_docs(spark, sf_dir), "the ons", limit=20)
    return hits.select("doc_id", "tf", "dl", r6(F.col("score")).alias("score"))
