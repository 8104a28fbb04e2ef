"""Packing documents into sequences by length patterns.

Spark tokenizes, cuts and counts the pieces by length.  The plan is made from
that histogram alone, which has one entry for each length at most: patterns
of a few documents that fill a sequence exactly are enumerated, their repeat
counts are fitted to the histogram by non-negative least squares and rounded,
and what is left is packed by best fit, largest first.  Every piece then
finds its place by its rank among the pieces of its length; ranks are counted
in salted groups, so no length's pieces meet in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm.common import materialize, read, tokenizer_path
from treeline.llm.pretokens import word_ids
from treeline.llm.registry import register

VOCABULARY = "word_bpe_49k.json"
SIZE = 2048
#: Pieces for each of the groups that one length's pieces are ranked in: all pieces may have one length.
RANKED_ROWS = 50_000


def cut_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = SIZE, ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, little-endian
    unsigned 32-bit, if asked) of every document's token ids followed by id 0,
    cut every ``size`` ids.  A null text is empty: one piece, the id 0.
    Repeated rows are documents of their own."""
    schema = [("doc_id", docs.schema["doc_id"].dataType.simpleString()), ("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")]
    schema += [("ids", "binary")] if ids else []

    def run(batches):
        words, width = word_ids(tokenizer_path(vocabulary)), 4 * size
        for b in _joined(batches):
            owner, piece, length, crc, data = [], [], [], [], []
            for k, of_text in enumerate(words.of(b["text"].to_pylist())):
                whole = of_text + bytes(4)
                for j, at in enumerate(range(0, len(whole), width)):
                    part = whole[at:at + width]
                    owner.append(k)
                    piece.append(j)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if ids:
                        data.append(part)
            columns = [b["doc_id"].take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(np.array(piece, np.int64) * size), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(data, pa.binary())] if ids else []), [n for n, _ in schema])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in schema))


def _joined(batches, nbytes: int = 8 << 20):
    """The batches of a task, joined up to about ``nbytes``: a stretch of text is then looked up once for many documents."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= nbytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def patterns(size: int, lengths: np.ndarray) -> np.ndarray:
    """Rows of up to four lengths (0: none) that sum to ``size``: all pairs,
    and for every longest document some ways to fill the rest with two or
    three more.  Only lengths that occur."""
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    out = [(a, size - a, 0, 0) for a in range((size + 1) // 2, size)]
    for a in range(max(1, size // 4), size - 1):
        r = size - a
        out += [(a, r - b, b, 0) for b in {r * k // 16 for k in range(1, 9)}]
        out += [(a, r - b - c, b, c) for b, c in ((r // 3, r // 3), (r // 4, r // 4), (r // 3, r // 6))]
    rows = np.sort(np.array([x for x in out if all(v >= 0 for v in x)], np.int64).reshape(-1, 4), axis=1)
    rows = np.unique(rows, axis=0)
    there[0] = True
    return rows[there[rows].all(axis=1)]


def fitted_counts(rows: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative repeat counts of the patterns, by least squares against
    the histogram (accelerated projected gradient)."""
    n = len(histogram)

    def use(x):
        y = np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), n)
        y[0] = 0
        return y
    v = np.ones(len(rows))
    for _ in range(20):  # the largest eigenvalue
        u = use(v)
        v = u[rows].sum(1)
        top = np.linalg.norm(v)
        v /= top
    x, x0, step = np.zeros(len(rows)), np.zeros(len(rows)), 1 / (1.05 * top)
    h = histogram.astype(float).copy()
    h[0] = 0
    for k in range(steps):
        y = x + k / (k + 3) * (x - x0)
        x0, x = x, np.maximum(0, y - step * (use(y) - h)[rows].sum(1))
    return x


def best_fit(histogram: np.ndarray, size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing over counts instead of documents: sequences that
    hold the same are one group.  [(contents [(length, how many)], sequences)]"""
    open_by_space: dict[int, list] = {}
    spaces: list[int] = []
    done = []

    def put(contents, space, count):
        if space == 0:
            done.append((contents, count))
            return
        if space not in open_by_space:
            open_by_space[space] = []
            insort(spaces, space)
        open_by_space[space].append((contents, count))
    for length in range(size, 0, -1):
        n = int(histogram[length])
        while n:
            k = bisect_left(spaces, length)
            if k == len(spaces):  # no sequence has room: new ones, as full as they get
                per = size // length
                if n >= per:
                    put([(length, per)], size - per * length, n // per)
                if n % per:
                    put([(length, n % per)], size - n % per * length, 1)
                break
            space = spaces[k]
            contents, count = open_by_space[space].pop()
            if not open_by_space[space]:
                del open_by_space[space], spaces[k]
            per = min(space // length, n)
            use = min(count, n // per)
            if use < count:
                put(contents, space, count - use)
            put([*contents, (length, per)], space - per * length, use)
            n -= use * per
    return done + [x for g in open_by_space.values() for x in g]


def plan(histogram: np.ndarray, size: int = SIZE) -> list[tuple[list[tuple[int, int]], int]]:
    """All sequences for a histogram of lengths (index: length), as
    [(contents [(length, how many)], sequences)]."""
    left, full = histogram.astype(np.int64).copy(), []
    if left[size]:
        full.append(([(size, 1)], int(left[size])))
        left[size] = 0
    rows = patterns(size, np.flatnonzero(left))
    if not len(rows):
        return full + best_fit(left, size)
    x = fitted_counts(rows, left)
    # a histogram of few documents may lose by rounding up: the rounding that needs the fewest sequences is taken
    tried = [_rounded(rows, n.astype(np.int64), left, size) for n in (np.rint(x), np.floor(x), np.floor(0.8 * x), np.floor(0.4 * x))]
    return full + min(tried, key=lambda t: sum(n for _, n in t))


def _rounded(rows: np.ndarray, counts: np.ndarray, histogram: np.ndarray, size: int) -> list:
    """The patterns so often as asked and as documents last, then the rest by best fit."""
    left, out = histogram.copy(), []
    for k in np.argsort(-counts, kind="stable")[:int((counts > 0).sum())]:
        lengths, many = np.unique(rows[k][rows[k] > 0], return_counts=True)
        n = int(min(counts[k], (left[lengths] // many).min()))
        if n > 0:
            left[lengths] -= n * many
            out.append((list(zip(lengths[::-1].tolist(), many[::-1].tolist())), n))
    return out + best_fit(left, size)


def places(sequences: list[tuple[list[tuple[int, int]], int]], size: int = SIZE) -> dict[str, np.ndarray]:
    """For each length, ranges of ranks and where they go; sorted by ``key``
    (length and first rank).  One entry for each length of each pattern."""
    used, rows, base = np.zeros(size + 1, np.int64), [], 0
    for contents, count in sequences:
        offset = 0
        for length, many in contents:
            rows.append(((length << 48) + used[length], used[length], many, offset, base))
            used[length] += many * count
            offset += many * length
        base += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("key", "first", "many", "offset", "base"), np.ascontiguousarray(table.T)))


def _placed(table):
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        t = table.value
        for length, rank in batches:
            n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
            k = np.searchsorted(t["key"], (n << 48) + r, side="right") - 1
            nth, j = np.divmod(r - t["first"][k], t["many"][k])
            yield pa.StructArray.from_arrays([pa.array(t["base"][k] + nth), pa.array(t["offset"][k] + j * n)], ["sequence_id", "offset"])

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "sequence_id long, offset long").asNondeterministic()


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (doc_id, piece, length from 1 to ``size``, more) with
    ``sequence_id`` and ``offset``: every sequence is filled without gaps
    from 0 and holds at most ``size``.  An empty table gives an empty one."""
    spark = pieces.sparkSession
    pieces = materialize(pieces, "stage")
    groups = max(1, pieces.count() // RANKED_ROWS)
    # digests of the ids, where present, tell apart pieces of documents that share an id
    told = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    pieces = pieces.withColumn("__salt", F.pmod(F.xxhash64(*told), F.lit(groups)).cast("int"))
    counts = pieces.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect():
        histogram[r.length] = r.n
    table = spark.sparkContext.broadcast(places(plan(histogram, size), size))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "__salt", F.coalesce(before, F.lit(0)).alias("__base"))
    within = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", *[c for c in ("ids_crc32",) if c in pieces.columns])
    ranked = pieces.join(base, ["length", "__salt"]).withColumn("__rank", F.col("__base") + F.row_number().over(within) - 1)
    own = [c for c in pieces.columns if c != "__salt"]
    return ranked.withColumn("__at", _placed(table)("length", "__rank")).select(*own, "__at.sequence_id", "__at.offset")


@register("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2,048 tokens."""
    return pack(cut_pieces(read(spark, sf_dir, "documents")))
