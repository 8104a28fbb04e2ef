"""Hybrid search (X6), its degraded form (X11), semantic id resolution
and hit-id set operations (U1, U2).

Both inputs are already limited hit lists (at most ``2 * limit`` rows
each), so the full outer merge and the positional scoring window run on a
few hundred rows regardless of corpus size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions import fixed
from treeline.operators import text_index


def fts_component(fts_hits: DataFrame) -> DataFrame:
    """FTS hits (id, score) -> (id, fts_score = 1 - i/n) in best-first order."""
    ranked = text_index.rank_scores(fts_hits, [F.desc("score"), F.asc("id")])
    return ranked.select("id", F.col("rank_score").alias("fts_score"))


def resolve_semantic(sem_hits: DataFrame, catalog_ids: DataFrame) -> DataFrame:
    """Keep semantic hits whose id still exists in the catalog."""
    return known_ids(sem_hits, catalog_ids)


def hybrid(fts_hits: DataFrame, sem_hits: DataFrame | None, limit: int,
           fts_weight: float = fixed.HYBRID_FTS_WEIGHT,
           semantic_weight: float = fixed.HYBRID_SEMANTIC_WEIGHT) -> DataFrame:
    """Weighted merge of FTS ranks and semantic similarities.

    ``fts_hits``: ``(id, score)`` top ``2*limit`` by BM25.
    ``sem_hits``: ``(id, score)`` top ``2*limit`` by similarity, or None when
    the semantic side is unavailable (X11: FTS alone, weight kept).
    """
    f = fts_component(fts_hits)
    if sem_hits is None:
        s = fts_hits.sparkSession.createDataFrame([], "id long, sem_score double")
    else:
        s = sem_hits.select(F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("sem_score"))
    merged = f.join(s, "id", "full_outer")
    merged = merged.select(
        "id",
        F.coalesce("fts_score", F.lit(0.0)).alias("fts_score"),
        F.coalesce("sem_score", F.lit(0.0)).alias("sem_score"),
    ).withColumn("score", F.lit(fts_weight) * F.col("fts_score") + F.lit(semantic_weight) * F.col("sem_score"))
    return merged.orderBy(F.desc("score"), F.asc("id")).limit(limit)


def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct union of two hit-id lists."""
    return a.select("id").union(b.select("id")).distinct()


def known_ids(ids: DataFrame, catalog: DataFrame) -> DataFrame:
    """Hits (a limited list, one row per id) whose id the catalog holds.
    The hits are the broadcast side and the catalog streams past them, so
    nothing that grows with the catalog is broadcast or shuffled."""
    return catalog.select("id").join(F.broadcast(ids), "id").dropDuplicates(["id"]).select(*ids.columns)


def attach(hits: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Catalog rows for a limited hit list, hit order kept
    (``rank`` or ``score`` columns stay on the hits).  The hit list is at
    most a few hundred rows, so it is the broadcast side; ids no longer in
    the catalog drop out."""
    return rows.join(F.broadcast(hits), key)
