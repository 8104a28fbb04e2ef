"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into blocks so that any two within the allowed distance
agree on at least two of them; fingerprints meet on every pair of blocks and
their Hamming distance is verified.  A key's group gives the links of a
spanning forest, never all pairs.  Keys with more members than a task should
compare are dealt with exactly and in linear work: each member also stands at
every point within half the distance, and members that are close enough share
such a point.  Connected links make the groups.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm.common import materialize, read, row_udf
from treeline.llm.components import components
from treeline.llm.registry import register

SHINGLE = 4
BITS = 4
#: Most members of a key that one task compares with each other.
MOST = 4096

#: Fixed value: A-Z lower-cased, all other bytes kept.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint; words are split at ASCII white space; 0 without words."""
    import xxhash

    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(line, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - shingle + 1]
        hashes = [digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1:].tolist())]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[k:k + (1 << 14)], np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def with_simhash(docs: DataFrame, shingle: int = SHINGLE, into: str = "simhash") -> DataFrame:
    """``docs`` (text) with a long column ``into``; a null text has no words: 0."""
    return docs.withColumn(into, row_udf(lambda: lambda t: simhash(t, shingle), "long", pa.int64())(F.col("text")))


def _keys(bits: int):
    """For each choice of blocks: an expression of their bits, tagged by the choice."""
    n = bits + 2
    edge = [64 * k // n for k in range(n + 1)]
    out = []
    for t, (i, j) in enumerate(combinations(range(n), 2)):
        part = [F.shiftrightunsigned("fp", edge[k]).bitwiseAND(F.lit((1 << (edge[k + 1] - edge[k])) - 1)) for k in (i, j)]
        both = F.shiftleft(part[0], edge[j + 1] - edge[j]).bitwiseOR(part[1])
        out.append(both.bitwiseOR(F.lit(t << 48)))
    return F.array(*out)


def _forest(bits: int):
    """Links of a spanning forest for every run of one key in a sorted partition."""
    def links(fps: np.ndarray) -> list[tuple[int, int]]:
        left, out = fps, []
        if len(fps) == 2:
            return [(fps[0], fps[1])] if int(np.bitwise_count(fps[0] ^ fps[1])) <= bits else []
        while len(left):  # take one, and all that hang together with it
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                at = queue.pop()
                near = np.bitwise_count(left ^ at) <= bits
                out += [(at, x) for x in left[near]]
                queue += list(left[near])
                left = left[~near]
        return out

    def run(batches):
        key, held = None, []
        for b in batches:
            keys, fps = b["key"].to_numpy(), b["fp"].to_numpy().view(np.uint64)
            found = []
            cut = np.flatnonzero(np.diff(keys)) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)]):
                if s == e:
                    continue
                if keys[s] != key:
                    found += links(np.concatenate(held)) if held else []
                    key, held = keys[s], []
                held.append(fps[s:e])
            yield _batch(found)
        yield _batch(links(np.concatenate(held)) if held else [])

    def _batch(found):
        x = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_pydict({"a": np.ascontiguousarray(x[:, 0]), "b": np.ascontiguousarray(x[:, 1])},
                                          pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    return run


def _around(radius: int):
    """Every member with every point within ``radius`` bits of it."""
    flips = np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(64), r)], np.uint64)

    def run(batches):
        for b in batches:
            fps = b["fp"].to_numpy().view(np.uint64)
            for k in range(0, len(fps), 32):
                part = fps[k:k + 32]
                yield pa.RecordBatch.from_pydict({"point": (part[:, None] ^ flips).ravel().view(np.int64), "fp": np.repeat(part, len(flips)).view(np.int64)})
    return run


def near_links(fps: DataFrame, bits: int = BITS, most: int = MOST) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column fp): their
    connected components are those of all pairs within ``bits`` bits."""
    keyed = fps.select("fp", F.explode(_keys(bits)).alias("key"))
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "stage")
    small = keyed.join(sizes.where(F.col("n") <= most), "key").select("key", "fp")
    links = small.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_forest(bits), "a long, b long")
    hot = keyed.join(sizes.where(F.col("n") > most), "key", "left_semi").select("fp").distinct()
    points = materialize(hot.mapInArrow(_around((bits + 1) // 2), "point long, fp long"), "stage") if sizes.where(F.col("n") > most).limit(1).count() else None
    if points is None:
        return links
    centre = points.groupBy("point").agg(F.min("fp").alias("a"))
    far = points.join(centre, "point").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return links.union(far)


def _groups(docs: DataFrame, shingle: int, bits: int) -> DataFrame:
    """doc_id, simhash, component (a fingerprint), component_id of every row."""
    own = materialize(with_simhash(docs.select("doc_id", "text"), shingle).select("doc_id", "simhash"), "stage")
    fps = materialize(own.groupBy(F.col("simhash").alias("fp")).agg(F.min("doc_id").alias("least")), "stage")
    groups = components(near_links(fps.select("fp"), bits))
    named = fps.join(groups, fps.fp == groups.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = named.join(least, "component").select("fp", "component", "component_id")
    return own.join(names, own.simhash == names.fp).select("doc_id", "simhash", "component", "component_id")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``doc_id, simhash, component_id`` for every row of ``docs`` (doc_id,
    text): component_id is the smallest doc_id that links reach, its own
    included.  Documents with equal fingerprints are linked; null and empty
    texts have fingerprint 0.  Null ids are grouped but never name a group; a
    group of only such rows has a null component_id.  Repeated rows stay.
    """
    return _groups(docs, shingle, bits).drop("component")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: that of its
    component_id (of rows that share the id, the one with the smallest
    fingerprint, then text); a group of only null ids keeps its smallest
    fingerprint.  Columns unchanged."""
    by = F.struct(F.col("doc_id").isNull().alias("__null"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("__id"), F.col("simhash").alias("__fp"))
    chosen = _groups(docs, shingle, bits).groupBy("component").agg(F.min(by).alias("k")).select("k.*")
    key = ["__null", "__id", "__fp"]
    marked = with_simhash(docs, shingle, "__fp").withColumn("__null", F.col("doc_id").isNull()).withColumn("__id", F.coalesce("doc_id", F.lit(0).cast("long")))
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("text").asc_nulls_first()))
    return marked.join(chosen, key, "left_semi").withColumn("__n", first).where("__n = 1").drop("__n", *key)


@register("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")
