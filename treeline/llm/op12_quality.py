"""Quality by regularised quadratic discriminant analysis.

A document becomes a short vector of transformed statistics of its whole text.
Spark sums, over all labelled documents, the moments of each class; each
class gets a Gaussian whose covariance is shrunk twice: towards the covariance
within classes, the more so the fewer examples it has, and then towards a
multiple of the identity, by the oracle approximating weight.  A document's
score is the difference of the classes' Mahalanobis log densities, computed
with Cholesky factors that are made once for a model.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import materialize, read
from treeline.llm.registry import register

#: The statistics, in order.
STATISTICS = ("characters", "words", "word_length", "word_spread", "upper", "digits", "marks", "other_marks", "beyond_ascii", "line_length",
              "distinct_words", "top_word", "distinct_lines", "marked_words", "sentence_length", "entropy", "distinct_trigrams")
_ODD = np.ones(128, bool)  # characters that are neither letters, digits, white space nor common punctuation
_ODD[[c for c in range(128) if chr(c).isalnum() or c in b" \t\n\x0b\x0c\r.,;:'\"?!()-"]] = False
_CLASS = np.zeros((4, 128), bool)  # upper case, digits, punctuation, odd marks
_CLASS[0, 65:91], _CLASS[1, 48:58], _CLASS[2, list(b".,;:'\"?!()-")], _CLASS[3] = True, True, True, _ODD


def _share(part: float, whole: float) -> float:
    """A smoothed share on the scale of log odds."""
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; null counts as empty."""
    text = text or ""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, plain = len(c), np.bincount(c[c < 128], minlength=128)
    upper, digits, marks, odd = (_CLASS * plain).sum(1)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    w = len(words)
    sizes = np.array([len(x) for x in words] or [0], float)
    kinds = Counter(words)
    # distinct runs of three characters among all
    runs = (c[:-2].astype(np.uint64) << np.uint64(42)) | (c[1:-1].astype(np.uint64) << np.uint64(21)) | c[2:] if n > 2 else c
    seen = plain[plain > 0] / max(n, 1)
    marked = sum(not x[-1].isalnum() and x[-1] not in ".,;:?!" or x[-2:] == "!!" for x in words)
    return [float(np.log1p(n)), float(np.log1p(w)), float(np.log1p(sizes.mean())), float(np.log1p(sizes.std())),
            _share(upper, n), _share(digits, n), _share(marks, n), _share(odd, n), _share(n - plain.sum(), n),
            float(np.log1p(n / max(len(lines), 1))), _share(len(kinds), w), _share(max(kinds.values(), default=0), w),
            _share(len(set(lines)), len(lines)), _share(marked, w),
            float(np.log1p(w / (1 + plain[46] + plain[33] + plain[63]))), float(-(seen * np.log(seen)).sum()),
            _share(len(np.unique(runs)), len(runs))]


def with_statistics(docs: DataFrame, into: str = "stats") -> DataFrame:
    """``docs`` (text) with the statistics as an array of doubles."""
    def run(batches):
        for batch in batches:
            yield pa.array([statistics(x) for x in batch.to_pylist()], pa.list_(pa.float64()))

    return docs.withColumn(into, _arrow(run, "array<double>")(F.col("text")))


def _arrow(run, kind: str):
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind).asNondeterministic()


@dataclass
class Model:
    """Centre and scale of the statistics; of both classes (0, 1) the mean and covariance of
    the scaled ones and the log of the smoothed share.  Without a Gaussian for each class
    (``covariances`` empty) every text gets the shares' score."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_shares: np.ndarray

    @cached_property
    def factors(self) -> list[tuple[np.ndarray, float]]:
        """Each class's inverse Cholesky factor and the log determinant of its covariance."""
        lower = [np.linalg.cholesky(s) for s in self.covariances]
        return [(np.linalg.solve(x, np.eye(len(x))), 2 * float(np.log(np.diag(x)).sum())) for x in lower]

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        """Difference of the log densities, class 1 less class 0, with the shares."""
        prior = self.log_shares[1] - self.log_shares[0]
        if not len(self.covariances):
            return np.full(len(rows), prior)
        z = (rows - self.centre) / self.scale
        density = [-0.5 * ((((z - m) @ f.T) ** 2).sum(1) + d) for m, (f, d) in zip(self.means, self.factors)]
        return prior + density[1] - density[0]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; 0.5 where both classes are as likely.  The log odds are divided
        by the number of statistics, which overlap, so that scores stay apart."""
        return 1 / (1 + np.exp(-np.clip(self.log_odds(rows) / len(STATISTICS), -36, 36)))


def oracle_shrinkage(s: np.ndarray, n: float) -> float:
    """Weight of the scaled identity by the oracle approximating shrinkage estimator."""
    p, t, t2 = len(s), np.trace(s), (s * s).sum()
    below = (n + 1 - 2 / p) * (t2 - t * t / p)
    return 1.0 if below <= 0 else float(min(1.0, ((1 - 2 / p) * t2 + t * t) / below))


def fit(counts: np.ndarray, means: np.ndarray, scatters: np.ndarray) -> Model:
    """Model from each class's count, mean and mean product of centred statistics."""
    p, n = means.shape[1], counts.sum()
    log_shares = np.log((counts + 0.5) / (n + 1))
    if counts.min() < 1:
        return Model(np.zeros(p), np.ones(p), np.zeros((2, p)), np.zeros((0, p, p)), log_shares)
    within = np.einsum("k,kij->ij", counts / n, scatters)
    centre, scale = counts @ means / n, np.sqrt(np.maximum(np.diag(within), 1e-6))
    means, scatters, within = (means - centre) / scale, scatters / np.outer(scale, scale), within / np.outer(scale, scale)
    out = []
    for k in range(2):
        s = (counts[k] * scatters[k] + p * within) / (counts[k] + p)
        r = oracle_shrinkage(s, counts[k])
        out.append((1 - r) * s + (r * np.trace(s) / p + 1e-6) * np.eye(p))
    return Model(centre, scale, means, np.array(out), log_shares)


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and centred mean product of ``stats`` for each ``quality``
    (0, 1), summed by Spark; a task adds up its own rows, so what is sent
    to the driver is two small matrices."""
    p = len(STATISTICS)

    def total(about: np.ndarray, products: bool):
        def run(batches):
            n, s = np.zeros(2, np.int64), np.zeros((2, p, p if products else 1))
            for b in batches:
                y, x = b["quality"].to_numpy(), b["stats"].flatten().to_numpy().reshape(-1, p)
                for k in (0, 1):
                    own = x[y == k] - about[k]
                    n[k] += len(own)
                    s[k] += own.T @ own if products else own.sum(0)[:, None]
            for k in (0, 1):
                yield pa.RecordBatch.from_pydict({"k": np.full(s[k].size, k, np.int32), "i": np.arange(s[k].size, dtype=np.int32), "n": np.full(s[k].size, n[k]), "s": s[k].ravel()})
        got = rows.select("quality", "stats").mapInArrow(run, "k int, i int, n long, s double").groupBy("k", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
        counts, sums = np.zeros(2), np.zeros((2, p * p if products else p))
        for r in got:
            counts[r.k], sums[r.k, r.i] = r.n, r.s
        return counts, sums / np.maximum(counts, 1)[:, None]
    counts, means = total(np.zeros((2, p)), False)
    return counts, means, total(means, True)[1].reshape(2, p, p)


def train(stats: DataFrame, labels: DataFrame, usable: Column | None = None) -> Model:
    """Fit on all documents (doc_id, stats) with labels (doc_id, quality 0/1).

    ``usable``: which label rows may be learnt from.  Null labels and ids
    without a document are ignored; an id with several labels counts as low
    if one of them says so; each row of a repeated id is an example.
    """
    y = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if usable is not None:
        y = y.where(usable)
    y = y.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    rows = materialize(stats.select("doc_id", "stats").join(y, "doc_id").select("quality", "stats"), "stage")
    return fit(*moments(rows))


def score(stats: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``stats`` with a double column ``into`` from 0 to 1 for every row."""
    held = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.array(held.value.score(batch.flatten().to_numpy().reshape(-1, len(STATISTICS))))
    return stats.withColumn(into, _arrow(run, "double")(F.col("stats")))


def fold() -> Column:
    """crc32 of doc_id as text, modulo 3 (null: as an empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3


def quality(docs: DataFrame, labels: DataFrame, usable: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """``docs`` (doc_id, text, more) with ``score`` and ``predicted``.

    Null and empty texts are scored too, by the statistics of an empty text;
    repeated rows stay and score alike.  Without examples of both classes
    every text gets the smoothed share of label 1.  Other columns stay, save
    ones named ``score``, ``predicted`` or ``stats``, which are replaced.
    """
    return judged(materialize(with_statistics(docs), "stage"), labels, usable, threshold)


def judged(stats: DataFrame, labels: DataFrame, usable: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """The same from a written table that has the statistics already."""
    scored = score(stats, train(stats, labels, usable))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("stats")


@register("op12_quality")
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; labels of the held-out third are never read."""
    stats = materialize(with_statistics(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "stage")
    out = judged(stats, read(spark, sf_dir, "labels"), fold() != 1)
    return out.select("doc_id", (fold() == 1).alias("held_out"), "score", "predicted")
