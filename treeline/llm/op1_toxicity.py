"""Toxicity by a linear classifier over character n-grams whose features are
scaled by naive Bayes log-count ratios.

Training sees a bounded sample of the labelled rows.  Spark counts, for every
hashed n-gram, the documents of each class that hold it; the ratio of these
counts scales the n-gram's feature, the n-grams that separate the classes
best are kept, and a logistic regression over the scaled features is fitted
in numpy.  Scoring is a projection over whole texts with a model of fixed
size; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import materialize, read, row_udf
from treeline.llm.registry import register

SIZES = (3, 4, 5)
#: Hash buckets of n-grams, and how many of them a model keeps: its size is bounded by these.
BUCKETS = 1 << 20
KEPT = 2048
#: Most labelled rows that a model is fitted on.
MAX_TRAIN = 12_000


def ngram_buckets(text: str) -> list[np.ndarray]:
    """Hash buckets of the character n-grams of a lower-cased text with a
    space at both ends, by size; every character counts, however long the text."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, max(SIZES) + 1):
        if len(c) < n:
            break
        h = h[:len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1:]
        if n in SIZES:
            x = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            out.append((x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return out


@dataclass
class Model:
    """Kept buckets, their weights (ratio times coefficient) and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        place = np.zeros(BUCKETS, np.uint16)
        place[self.buckets] = np.arange(1, len(self.buckets) + 1)
        weights = np.concatenate([[0.0], self.weights])

        def score(text: str | None) -> float:
            held = np.zeros(len(weights), bool)
            for b in ngram_buckets(text or ""):
                held[place[b]] = True
            z = self.bias + float(weights[held].sum())
            return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))
        return score


def _counts(batches):
    """Documents of each class that hold a bucket, over the rows of a task."""
    seen = {0: np.zeros(BUCKETS, np.int32), 1: np.zeros(BUCKETS, np.int32)}
    for b in batches:
        for text, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist()):
            held = np.zeros(BUCKETS, bool)
            for g in ngram_buckets(text or ""):
                held[g] = True
            seen[y][held] += 1
    k = np.flatnonzero(seen[0] + seen[1])
    for at in range(0, len(k), 1 << 16):
        part = k[at:at + (1 << 16)]
        yield pa.RecordBatch.from_pydict({"bucket": part.astype(np.int32), "no": seen[0][part].astype(np.int64), "yes": seen[1][part].astype(np.int64)})


def _features(place: np.ndarray):
    def run(batches):
        for b in batches:
            rows = []
            for text in b["text"].to_pylist():
                held = np.zeros(KEPT + 1, bool)
                for g in ngram_buckets(text or ""):
                    held[place[g]] = True
                rows.append(np.flatnonzero(held[1:]).astype(np.int16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b["toxic"]], ["held", "toxic"])
    return run


def logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, ridge: float = 1e-3, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression over sparse features of value ``scale``, by
    accelerated gradient descent; the bias has no penalty."""
    col = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = scale[col]
    n = len(rows)
    most = max(1.0, float(np.bincount(row, value * value, n).max(initial=0.0))) / 4 + 0.25
    w, b, w0, b0 = np.zeros(len(scale)), 0.0, np.zeros(len(scale)), 0.0
    for k in range(steps):
        m = k / (k + 3)
        u, c = w + m * (w - w0), b + m * (b - b0)
        p = 1 / (1 + np.exp(-np.clip(c + np.bincount(row, value * u[col], n), -35, 35)))
        e = (p - y) / n
        w0, b0 = w, b
        w = u - (np.bincount(col, value * e[row], len(scale)) + ridge * u) / most
        b = c - float(e.sum()) / most
    return w, b


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_train: int = MAX_TRAIN) -> Model:
    """Fit on documents (doc_id, text) with labels (doc_id, toxic 0/1).

    ``usable``: which label rows may be learnt from.  At most ``max_train``
    labelled ids are used, those with the smallest hash.  Null labels and
    ids without a document are ignored; an id with several labels counts as
    toxic if one of them says so.  Without examples of both classes the
    model gives every text the smoothed share of toxic labels.
    """
    y = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if usable is not None:
        y = y.where(usable)
    y = (y.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
         .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").select("text", "toxic"), "stage").coalesce(6)
    tally = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    yes, no = tally.get(1, 0), tally.get(0, 0)
    prior = float(np.log((yes + 0.5) / (no + 0.5)))
    if not yes or not no:
        return Model(np.zeros(0, np.int64), np.zeros(0), prior)
    p, q = (F.col("yes") + 1) / (yes + 2), (F.col("no") + 1) / (no + 2)
    share = (F.col("yes") + F.col("no")) / (yes + no)
    gain = yes / (yes + no) * _divergence(p, share) + no / (yes + no) * _divergence(q, share)
    best = (sample.mapInArrow(_counts, "bucket int, no long, yes long").groupBy("bucket")
            .agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).where("yes + no >= 3 and yes + no < %d" % (yes + no))
            .select("bucket", F.log(p / q).alias("ratio"), gain.alias("gain")).orderBy(F.desc("gain"), "bucket").limit(KEPT).collect())
    buckets, ratio = np.array([r.bucket for r in best], np.int64), np.array([r.ratio for r in best])
    if not len(buckets):
        return Model(buckets, ratio, prior)
    place = np.zeros(BUCKETS, np.uint16)
    place[buckets] = np.arange(1, len(buckets) + 1)
    rows = sample.mapInArrow(_features(place), "held binary, toxic int").collect()
    w, b = logistic([np.frombuffer(r.held, np.int16) for r in rows], np.array([r.toxic for r in rows], float), ratio)
    return Model(buckets, w * ratio, b)


def _divergence(a: Column, b: Column) -> Column:
    b = F.least(F.greatest(b, F.lit(1e-9)), F.lit(1 - 1e-9))
    return a * F.log(a / b) + (1 - a) * F.log((1 - a) / (1 - b))


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``docs`` (text) with a double column ``into`` from 0 to 1; null and
    empty texts have a score too.  Repeated rows and other columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(into, row_udf(lambda: held.value.scorer(), "double", pa.float64())(F.col("text")))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``; columns unchanged."""
    return score(docs, model, "__toxic").where(F.col("__toxic") < threshold).drop("__toxic")


def fold() -> Column:
    """crc32 of doc_id as text, modulo 5 (null: as an empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


@register("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"), fold() != 0)
    return score(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"))
