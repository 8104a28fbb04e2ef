"""Connected components of a link table, by alternating large and small stars.

Every round rewrites the links so that nodes point to smaller neighbours; it
ends when the links are stars.  Rounds are written to the shared folder, so
lineage stays short and a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import discard, materialize


def _stars(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("least").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("least"))
    pairs = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("x"))
    return pairs.select("x.a", "x.b").where("a <> b").distinct()


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, component`` for every node of ``links`` (a, b of one ordered
    type): component is the smallest node that can be reached.  Loops and
    repeated links are allowed; links with a null end are ignored."""
    now = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .where("a <> b").distinct(), "stage")
    before = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before, last, now = mark, now, materialize(_stars(now), "stage")
        discard(last)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
