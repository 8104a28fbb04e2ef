"""Document fingerprints: one-permutation MinHash, optimally densified, with
packed low-order bits.

A shingle's hash is computed once; its first bits choose a bin and each bin
keeps its smallest hash.  An empty bin borrows from the first filled one in an
order that is random but fixed for the bin (optimal densification: borrowed
bins are independent of each other).  Of each bin, four low bits are stored;
likeness is corrected for bins that agree by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import read, row_udf
from treeline.llm.registry import register

#: Words of a shingle, bins (a power of two), stored bits of a bin.
SHINGLE, BINS, BITS = 5, 256, 4
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_EDGES = np.arange(BINS, dtype=np.uint64) << _SHIFT


def _probes() -> np.ndarray:
    """For each bin, the order in which it asks the others."""
    rng = np.random.default_rng(20170805)
    return np.argsort(rng.random((BINS, BINS)), axis=1)


class Fingerprinter:
    """Fingerprints of texts; hashes of words are kept, up to ``most`` of them."""

    def __init__(self, most: int = 500_000):
        import xxhash

        self.digest, self.most, self.words = xxhash.xxh64_intdigest, most, {}
        self.factors = np.random.default_rng(7).integers(1, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
        self.probes = _probes()

    def _word(self, w: str) -> int:
        h = self.words.get(w)
        if h is None:
            if len(self.words) >= self.most:
                self.words.clear()
            h = self.words[w] = self.digest(w, 7)
        return h

    def shingles(self, text: str | None) -> np.ndarray:
        words = text.split() if text else []
        h = np.fromiter(map(self._word, words), np.uint64, len(words))
        n = min(SHINGLE, len(h))
        if not n:
            return h
        x = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            x += h[k:len(h) - n + 1 + k] * self.factors[k]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))

    def __call__(self, text: str | None) -> np.ndarray:
        """BINS small numbers; an empty array for a text without words."""
        h = np.sort(self.shingles(text))
        if not len(h):
            return np.zeros(0, np.uint8)
        first = np.searchsorted(h, _EDGES)
        filled = first < np.append(first[1:], len(h))
        out = np.zeros(BINS, np.uint8)
        out[filled] = (h[first[filled]] & np.uint64((1 << BITS) - 1)).astype(np.uint8)
        empty = np.flatnonzero(~filled)
        if len(empty):
            asked = self.probes[empty]
            out[empty] = out[asked[np.arange(len(empty)), filled[asked].argmax(1)]]
        return out


def packed(bins: np.ndarray) -> str:
    """Hex digits, one for each bin; zeros for a text without words."""
    return bytes(bins[0::2] << 4 | bins[1::2]).hex() if len(bins) else "0" * (BINS * BITS // 4)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; two texts without words are alike, one such text is like no other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    chance = 2.0 ** -BITS
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def with_fingerprint(docs: DataFrame, into: str = "fingerprint") -> DataFrame:
    """``docs`` (text) with a string column ``into``; null texts have no words."""
    def make():
        of = Fingerprinter()
        return lambda t: packed(of(t))
    return docs.withColumn(into, row_udf(make, "string", pa.string())(F.col("text")))


def with_followers(docs: DataFrame, value, schema: str, arrow: pa.Schema) -> DataFrame:
    """Calls ``value()(doc_id, text, next text)`` for every row of ``docs``
    (doc_id, text) and the one after it in ascending order of (doc_id, text);
    the first row follows the last.  Null ids come last.

    Rows go to ranges of ids; a range's first row is also sent to the range
    before it, so one shuffle suffices and no window spans the table.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = (1 << 63) - 1
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("key"))
    cuts = np.unique(np.array(keyed.where(F.col("key") < last).approxQuantile("key", [k / parts for k in range(1, parts)], 0.1 / parts) or [], float)).astype(np.int64)

    def part_of(keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(cuts, keys, side="right")

    def parts_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(part_of(b.to_numpy(zero_copy_only=False)).astype(np.int32))
    parts_udf.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    ranged = keyed.withColumn("part", F.arrow_udf(parts_udf, "int")("key"))
    firsts = sorted((r.part, r.key) for r in ranged.groupBy("part").agg(F.min("key").alias("key")).collect())  # one for each range
    if not firsts:
        return spark.createDataFrame([], schema)
    before = {key: firsts[k - 1][0] for k, (_, key) in enumerate(firsts)}
    keys, to = np.array(sorted(before), np.int64), np.array([before[k] for k in sorted(before)], np.int32)

    def goals_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            k = b.to_numpy(zero_copy_only=False)
            own = part_of(k) * 2
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            again = keys[at] == k
            yield pa.array([[o, t * 2 + 1] if a else [o] for o, a, t in zip(own.tolist(), again.tolist(), to[at].tolist())], pa.list_(pa.int32()))
    goals_udf.__annotations__ = parts_udf.__annotations__
    sent = keyed.withColumn("goal", F.explode(F.arrow_udf(goals_udf, "array<int>").asNondeterministic()("key")))
    sent = sent.withColumn("part", F.floor(F.col("goal") / 2).cast("int")).repartition(parts, "part").sortWithinPartitions("part", "goal", "key", "text")

    def run(batches):
        call, held = value(), None
        for b in batches:
            out = []
            for row in zip(*(b[c].to_pylist() for c in ("part", "goal", "doc_id", "text"))):
                if held is not None and row[0] == held[0]:
                    out.append(call(held[2], held[3], row[3]))
                held = None if row[1] & 1 else row
            yield pa.RecordBatch.from_pylist(out, arrow)

    return sent.mapInArrow(run, schema)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited(text: str, follower: str) -> str:
    """The last half of the text's characters replaced by as many first ones of its follower (or all)."""
    half = len(text) // 2
    return text[:len(text) - half] + follower[:half]


def _compared():
    of = Fingerprinter()
    known: list = [None, None]  # the follower is the next row's text

    def call(doc_id, text, follower):
        text, follower = text or "", follower or ""
        own = known[1] if known[0] == text else of(text)
        other, changed = of(follower), edited(text, follower)
        new = of(changed)
        known[:] = follower, other
        return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(), "fingerprint": packed(own),
                "edited_fingerprint": packed(new), "near_edited": likeness(own, new), "near_next": likeness(own, other)}
    return call


@register("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_followers(read(spark, sf_dir, "documents").select("doc_id", "text"), _compared, _SCHEMA, _ARROW)
