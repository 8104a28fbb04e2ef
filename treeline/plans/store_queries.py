"""Registered catalog-store round trip."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from treeline.plans.registry import register
from treeline.plans.standins import BRIDGE_SQL, PROJECTS_SQL, keyword_bridge, projects
from treeline.sources.store import CatalogStore


@register("s10_roundtrip", "WITH " + PROJECTS_SQL + ",\n" + BRIDGE_SQL + """
SELECT p.id, p.name, p.primary_language, p.lines_of_code,
       (SELECT count(*) FROM bridge b WHERE b.project_id = p.id)::BIGINT AS n_keywords
FROM proj p""")
def s10_roundtrip(spark, sf_dir):
    """Create projects, keyword bridge and a scratch table, drop the latter, read back."""
    store = CatalogStore(spark, f"treeline_s10_{uuid.uuid4().hex[:8]}")
    store.reset({"projects": "id long"})
    store.publish({"projects": projects(spark, sf_dir), "project_keywords": keyword_bridge(spark, sf_dir),
                   "scratch": projects(spark, sf_dir).select("id")})
    store.drop("scratch")
    p = store.read("projects")
    k = store.read("project_keywords").groupBy(F.col("project_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_keywords"))
    return p.join(k, "id", "left").select(
        "id", "name", "primary_language", "lines_of_code",
        F.coalesce("n_keywords", F.lit(0)).cast("long").alias("n_keywords"))
