"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors are counted in whole numbers, so that equal ones are found exactly and
the mean is that of integers.  The leading eigenvectors of the covariance are
found without ever forming it: a block of trial directions Q goes to the
tasks, each adds up its centred products X'(XQ), and Spark sums these.  A
polynomial in the covariance, made of such passes by the Chebyshev recurrence,
damps the part of the spectrum below the block; then QR and Rayleigh-Ritz turn
the block into approximate eigenvectors.  This goes on until their residuals
are at rounding level.  If the spectrum is too flat for that, the block grows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import materialize, read
from treeline.llm.registry import register

COMPONENTS = 4
#: Trial directions beyond the wanted ones, passes of a filter, filters before the block is doubled.
GUARD, DEGREE, PATIENCE = 28, 10, 12
#: Residuals of a certified component, as a share of the largest eigenvalue.
CERTAIN = 1e-12
#: Bytes of the integers of one block of vectors.
BLOCK_BYTES = 1 << 20


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, x``: the rows whose vector holds only finite numbers, as
    floor(256 * c); vectors shorter than the longest are filled up with 0."""
    sound = embeddings.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))))
    rows = materialize(sound.select("vec_id", F.transform("embedding", lambda c: F.floor(256 * c.cast("double"))).alias("x")), "stage")
    ends = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if ends[0] != ends[1]:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(ends[1]) - F.size("x"))))
    return rows


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def blocks_of(vectors: DataFrame) -> DataFrame:
    """``n, x``: the distinct vectors (array column ``x``), many to a row, as little-endian integers."""
    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(_matrix(b["x"]))
            size += held[-1].nbytes
            if size >= BLOCK_BYTES:
                yield _block(held)
                held, size = [], 0
        if sum(map(len, held)):
            yield _block(held)
    return vectors.select("x").distinct().mapInArrow(run, "n int, x binary")


def _block(parts: list[np.ndarray]) -> pa.RecordBatch:
    x = np.concatenate(parts)
    return pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([x.astype("<i8").tobytes()], pa.binary())], ["n", "x"])


def _blocks(batches):
    for b in batches:
        for n, x in zip(b["n"].to_pylist(), b["x"].to_pylist()):
            yield np.frombuffer(x, "<i8").reshape(n, -1)


def sums(blocks: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and their sums by dimension, exact at any size."""
    def run(batches):
        for x in _blocks(batches):
            d = x.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, len(x), np.int64)),
                                              pa.array((x >> 32).sum(0)), pa.array((x & 0xFFFFFFFF).sum(0))], ["i", "n", "high", "low"])
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    got = sorted(blocks.mapInArrow(run, "i int, n long, high long, low long").groupBy("i").agg(*exact).collect())
    return (int(got[0].n), [(int(r.high) << 32) + int(r.low) for r in got]) if got else (0, [])


def total(blocks: DataFrame, part, width: int) -> np.ndarray:
    """Sum over all blocks of the matrices ``part(x)`` of ``width`` columns; a
    task sends one matrix, Spark adds the rows up."""
    names = [f"c{j}" for j in range(width)]

    def run(batches):
        own = None
        for x in _blocks(batches):
            y = part(x)
            own = y if own is None else own + y
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own), dtype=np.int32)), *map(pa.array, np.ascontiguousarray(own.T))], ["i", *names])
    got = blocks.mapInArrow(run, ", ".join(["i int"] + [f"{c} double" for c in names])).groupBy("i").agg(*[F.sum(c).alias(c) for c in names])
    return np.array([r[1:] for r in sorted(got.collect())]).reshape(-1, width)


@dataclass
class Whitening:
    """``n`` fitted vectors, their exact sums, mean, trace of the covariance, its leading
    eigenvalues and eigenvectors (columns), their residuals, and the passes it took."""

    n: int
    sums: list[int]
    mean: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int = 0
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of integer vectors, one column for each component."""
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)


def leading(covariance, d: int, wanted: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, seed: int = 13):
    """Largest eigenvalues, eigenvectors and residuals of a covariance that is
    given as the function Q -> VQ alone."""
    rng = np.random.default_rng(seed)
    wanted, b = min(wanted, d), min(d, wanted + guard)
    q = np.linalg.qr(rng.standard_normal((d, b)))[0]
    w, worst, rounds = covariance(q), np.inf, 0
    while True:
        value, turn = np.linalg.eigh((q.T @ w + w.T @ q) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        q, w = q @ turn, w @ turn
        residual = np.linalg.norm(w[:, :wanted] - q[:, :wanted] * value[:wanted], axis=0)
        before, worst = worst, float(residual.max(initial=0.0))
        top = max(float(value[0]), 0.0)
        # certified once the residuals are at rounding level, or as near to it as they get
        if b == d or worst <= 1e-15 * top or worst <= CERTAIN * top and worst > before / 2:
            return value[:wanted], q[:, :wanted], residual
        rounds += 1
        if rounds % PATIENCE == 0:
            grown = min(d, 2 * b)
            q = np.linalg.qr(np.hstack([q, rng.standard_normal((d, grown - b))]))[0]
            w, b, worst = covariance(q), grown, np.inf
            continue
        half = float(value[-1]) / 2  # what lies between 0 and the block's least value is damped
        if half <= 1e-14 * top:
            q = np.linalg.qr(w)[0]
        else:
            scale = half / (top - half)
            first, sigma = scale, scale
            old, now = q, (w - half * q) * (sigma / half)
            for _ in range(degree - 1):
                following = 1 / (2 / first - sigma)
                old, now = now, (covariance(now) - half * now) * (2 * following / half) - (sigma * following) * old
                sigma = following
            q = np.linalg.qr(now)[0]
        w = covariance(q)


def fit(vectors: DataFrame, wanted: int = COMPONENTS) -> Whitening:
    """Whitening of the distinct vectors (array column ``x``).  Components
    without variance (to double precision) are left out."""
    blocks = materialize(blocks_of(vectors), "stage")
    n, s = sums(blocks)
    d, passes = len(s), 0
    mean = np.array([v / n for v in s])
    if not n or not d:
        return Whitening(n, s, mean, 0.0, np.zeros(0), np.zeros((d, 0)), np.zeros(0))
    context = blocks.sparkSession.sparkContext

    def covariance(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        held = context.broadcast((mean, q))

        def part(x):
            centre, directions = held.value
            c = x - centre
            return c.T @ (c @ directions)
        out = total(blocks, part, q.shape[1]) / n
        held.destroy()
        return out
    trace = float(total(blocks, lambda x: ((x - mean) ** 2).sum().reshape(1, 1), 1)[0, 0]) / n
    if trace <= 0:
        return Whitening(n, s, mean, 0.0, np.zeros(0), np.zeros((d, 0)), np.zeros(0))
    values, q, residuals = leading(covariance, d, wanted)
    some = values > d * np.finfo(float).eps * values[0]
    out = Whitening(n, s, mean, trace, values[some], q[:, some], residuals[some], passes)
    k = int(some.sum())
    held = context.broadcast(out)
    middle = total(blocks, lambda x: held.value.project(x).sum(0, keepdims=True), k)[0] / n

    def products(x):
        z = held.value.project(x) - middle
        return z.T @ z
    out.identity_error = float(np.abs(total(blocks, products, k) / n - np.eye(k)).max())
    return out


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int]:
    """Exact sum over dimensions of (n * x - s) ** 2 for every row."""
    most = int(np.abs(x).max(initial=0))
    if 0 <= most and most * max(most, 1 << 30) * max(1, len(s)) >= 1 << 62 or max(map(abs, s), default=0) >= 1 << 89:
        return [sum((n * v - t) ** 2 for v, t in zip(row, s)) for row in x.tolist()]
    parts = [np.array([(v >> k if k == 60 else (v >> k) & 0x3FFFFFFF) for v in s], np.int64) for k in (0, 30, 60)]
    low, mid, high = ((x @ p).tolist() for p in parts)
    squares, own = (x * x).sum(1).tolist(), sum(v * v for v in s)
    return [n * n * q - 2 * n * (a + (b << 30) + (c << 60)) + own for q, a, b, c in zip(squares, low, mid, high)]


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """One row for each vector (vec_id, x) and component; see ``whitened``."""
    k, kind = len(model.values), vectors.schema["vec_id"].dataType.simpleString()
    held = vectors.sparkSession.sparkContext.broadcast(model)
    schema = f"vec_id {kind}, component int, n long, deviation long, deviation_decimal decimal(38,0), whitened double, explained double, identity_error double"

    def run(batches):
        m = held.value
        for b in batches:
            x = _matrix(b["x"])
            if not len(x) or not k:
                continue
            exact = deviations(x, m.n, m.sums)
            far = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            wide = pa.array([Decimal(v) if v < 10 ** 38 else None for v in exact], pa.decimal128(38, 0))
            row = pa.array(np.repeat(np.arange(len(x)), k))
            size = len(x) * k
            yield pa.RecordBatch.from_arrays([
                b["vec_id"].take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(size, m.n, np.int64)), far.take(row), wide.take(row),
                pa.array(m.project(x).ravel()), pa.array(np.tile(m.values / m.trace, len(x))), pa.array(np.full(size, m.identity_error))],
                ["vec_id", "component", "n", "deviation", "deviation_decimal", "whitened", "explained", "identity_error"])
    return vectors.select("vec_id", "x").mapInArrow(run, schema)


def whitened(embeddings: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """``embeddings`` (vec_id, embedding, more) whitened along the ``wanted``
    leading components: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null or non-finite entry go.  The fit
    counts each distinct vector once; repeated rows are returned as often as
    they come, null ids stay.  Vectors shorter than the longest are filled up
    with zeros.  ``deviation`` is null beyond 64 bits, where
    ``deviation_decimal`` still has it.  Components without variance are left
    out: an empty table, or equal vectors only, give no rows.
    """
    vectors = whole_vectors(embeddings)
    return whiten(vectors, fit(vectors, wanted))


@register("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings along the four leading components."""
    return whitened(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
