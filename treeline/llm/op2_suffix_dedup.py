"""Exact substring deduplication by partitioned suffix sorting.

A position whose next ``size`` bytes start anywhere else too is a repeat;
bytes covered by a repeat go.  Positions are grouped by anchors: the anchor
of a position is the k-gram of smallest hash among those in its ``size``
bytes, so equal strings have equal anchors at equal offsets.  Runs of
positions with one anchor are segments.  An anchor that occurs once rules its
segment out, and segments whose texts are all equal are repeats as a whole;
neither needs sorting.  What is left is sorted: a task gets whole groups of
segments that share an anchor's k-gram and builds the suffix array of their
positions by deep-shallow sorting.  A k-gram with more different segments
than one task should hold is split by content instead: equal strings meet
one by one, counted before the shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import materialize, read
from treeline.llm.registry import register
from treeline.llm.suffix_sort import repeated

SIZE = 400
#: Bytes of an anchor's k-gram, and most different segments of one that a task sorts together.
KGRAM, MOST = 200, 1000
#: Bytes of segments that are sorted at once.
BATCH = 2 << 20

_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any stretch of a byte string, from prefix sums of a rolling hash."""

    _powers: tuple = (np.zeros(0, np.uint64),) * 2

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Hashes._powers[0]) < n:
            Hashes._powers = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        up, self.down = Hashes._powers
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_BYTE[data] * up[:n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    rows = padded.reshape(blocks, width)
    left = np.minimum.accumulate(rows, 1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:len(x) - width + 1], left[width - 1:len(x)])


def segments(data: bytes, size: int = SIZE, kgram: int = KGRAM):
    """Runs of positions of one document with one anchor: hashes of the
    anchor's k-gram and of the run's text, first and last position."""
    if len(data) < size:
        return (np.zeros(0, np.int64),) * 4
    h = Hashes(np.frombuffer(data, np.uint8))
    grams = h.all(kgram)
    # by the first half of the hash, then by place: a choice that depends on the window's bytes alone
    marked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_least(marked, size - kgram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], len(anchor)) - 1
    return grams[anchor[first]].view(np.int64), h.of(first, last + size).view(np.int64), first, last


_KEYS = ["doc_id", "text_id"]


def _text_id(text: str | None) -> int:
    return zlib.crc32(text.encode()) - (1 << 31) if text else -(1 << 31)


def _checksum() -> Column:
    """With its id, this names a row: ids may be null or shared."""
    return (F.crc32(F.coalesce("text", F.lit("")).cast("binary")) - (1 << 31)).cast("int")


def _all_segments(docs: DataFrame, size: int, kgram: int) -> DataFrame:
    schema = "gram long, whole long, doc_id long, text_id int, first int, last int"

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for k, t in enumerate(b["text"].to_pylist()):
                gram, whole, first, last = segments((t or "").encode(), size, kgram)
                for column, x in zip(out, (gram, whole, np.full(len(gram), k), np.full(len(gram), _text_id(t)), first, last)):
                    column.append(x)
            gram, whole, owner, text_id, first, last = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(whole), b["doc_id"].take(pa.array(owner, pa.int64())), pa.array(text_id.astype(np.int32)),
                                              pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["gram", "whole", "doc_id", "text_id", "first", "last"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _slices(size: int):
    """The texts of the asked segments of each document."""
    def run(batches):
        for b in batches:
            rows = []
            for d, i, t, asked in zip(*(b[c].to_pylist() for c in ("doc_id", "text_id", "text", "asked"))):
                data = t.encode()
                rows += [{"gram": a["gram"], "doc_id": d, "text_id": i, "first": a["first"], "n": a["n"], "crowded": a["crowded"], "data": data[a["first"]:a["last"] + size]} for a in asked]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("text_id", pa.int32()), ("first", pa.int32()), ("n", pa.int64()), ("crowded", pa.bool_()), ("data", pa.binary()), ("text", pa.string())]))
    return run


_SPANS = pa.schema([("doc_id", pa.int64()), ("text_id", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])


def _sorted_spans(size: int):
    """Repeats among segments that come sorted by k-gram: a suffix array over
    each batch of whole groups."""
    def spans(held: list[dict]) -> pa.RecordBatch:
        data = b"".join(r["data"] for r in held)
        base = np.cumsum([0] + [len(r["data"]) for r in held])
        count = np.array([len(r["data"]) - size + 1 for r in held])
        edge = np.cumsum(np.append(0, count))
        starts = np.arange(edge[-1]) - np.repeat(edge[:-1], count) + np.repeat(base[:-1], count)
        again = repeated(data, starts, size)
        out = []
        for k, r in enumerate(held):
            if r["n"] == 1:  # others are repeats as a whole
                flags = again[edge[k]:edge[k + 1]].astype(np.int8)
                cut = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]])))
                out += [{"doc_id": r["doc_id"], "text_id": r["text_id"], "start": r["first"] + int(s), "stop": r["first"] + int(e) - 1 + size} for s, e in zip(cut[::2], cut[1::2])]
        return pa.RecordBatch.from_pylist(out, _SPANS)

    def run(batches):
        held, nbytes = [], 0
        for b in batches:
            for r in b.to_pylist():
                if nbytes >= BATCH and r["gram"] != held[-1]["gram"]:
                    yield spans(held)
                    held, nbytes = [], 0
                held.append(r)
                nbytes += len(r["data"])
        if held:
            yield spans(held)
    return run


def _strings(size: int):
    """Every string of the crowded segments, by two hashes."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                raw = np.frombuffer(r["data"], np.uint8)
                a, other = Hashes(raw).all(size).view(np.int64), Hashes(raw[::-1].copy()).all(size)[::-1].copy().view(np.int64)
                n = len(a)
                yield pa.RecordBatch.from_pydict({"a": a, "b": other, "doc_id": pa.array([r["doc_id"]] * n, pa.int64()), "text_id": pa.array([r["text_id"]] * n, pa.int32()),
                                                  "start": np.arange(n, dtype=np.int32) + np.int32(r["first"]), "n": np.full(n, r["n"], np.int64)})
    return run


def repeat_spans(docs: DataFrame, size: int = SIZE, kgram: int = KGRAM, most: int = MOST) -> DataFrame:
    """``doc_id, text_id, start, stop``: byte spans whose every byte is
    covered by a ``size``-byte string that starts anywhere else too.  Spans
    may overlap; together they are all such bytes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _checksum().alias("text_id"), "text")
    found = materialize(_all_segments(docs, size, kgram), "stage")
    # aggregates are written before they are joined: a join of two shuffled sides can split a frequent k-gram's rows
    shared = found.groupBy("gram").agg(F.count("*").alias("rows"), F.min("whole").alias("low"), F.max("whole").alias("high")).where("rows > 1")
    shared = materialize(shared.select("gram", (F.col("low") == F.col("high")).alias("equal")), "stage")
    # dealt by place: a frequent k-gram's rows then come from many tasks, so that the next join can split them
    several = materialize(found.join(shared, "gram").repartition("doc_id", "text_id", "first"), "stage")
    stop = (F.col("last") + size).alias("stop")
    out = several.where("equal").select(*_KEYS, F.col("first").alias("start"), stop)
    mixed = several.where("not equal")
    kinds = materialize(mixed.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_id", "first", "last")).alias("one")), "stage")
    copied = mixed.join(kinds.where("n > 1").select("gram", "whole"), ["gram", "whole"], "left_semi")
    out = out.union(copied.select(*_KEYS, F.col("first").alias("start"), stop))
    crowds = materialize(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).select("gram", (F.col("kinds") > most).alias("crowded")), "stage")
    asked = kinds.join(crowds, "gram").select("gram", "one.*", "n", "crowded").groupBy(F.col("doc_id").alias("id"), F.col("text_id").alias("tid")).agg(
        F.collect_list(F.struct("gram", "first", "last", "n", "crowded")).alias("asked"))  # at most a document's own segments
    texts = docs.join(asked, docs.doc_id.eqNullSafe(asked.id) & (docs.text_id == asked.tid)).select(*_KEYS, "text", "asked")
    cut = materialize(texts.mapInArrow(_slices(size), "gram long, doc_id long, text_id int, first int, n long, crowded boolean, data binary"), "stage")
    few = cut.where("not crowded").drop("crowded").repartition("gram").sortWithinPartitions("gram")
    spans = "doc_id long, text_id int, start int, stop int"
    out = out.union(few.mapInArrow(_sorted_spans(size), spans))
    strings = materialize(cut.where("crowded").mapInArrow(_strings(size), "a long, b long, doc_id long, text_id int, start int, n long"), "stage")
    again = strings.groupBy("a", "b").agg(F.sum("n").alias("all")).where("all > 1").select("a", "b")
    hot = strings.where("n = 1").join(again, ["a", "b"], "left_semi")
    return out.union(hot.select(*_KEYS, "start", (F.col("start") + size).alias("stop")))


def without_repeats(docs: DataFrame, size: int = SIZE, into: str = "kept") -> DataFrame:
    """``docs`` (doc_id, text) with a struct column ``into``: n_bytes (UTF-8),
    spans (maximal removed byte runs, stop exclusive), data, the bytes
    that stay, and text, the same as a string (a character that a cut parts
    becomes U+FFFD).

    Null texts count as empty.  Matches never cross documents; all copies of
    a repeated string go.  Repeated rows are documents of their own, so they
    repeat each other.  Other columns are untouched.
    """
    spans = repeat_spans(docs, size).groupBy(F.col("doc_id").alias("__id"), F.col("text_id").alias("__tid")).agg(
        F.collect_set(F.struct("start", "stop")).alias("__spans"))  # at most a document's own segments
    own = docs.withColumn("__text_id", _checksum())
    joined = own.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text_id") == F.col("__tid")), "left")
    return joined.withColumn(into, _cut_out()("text", "__spans")).drop("__id", "__tid", "__text_id", "__spans")


_KEPT = pa.struct([("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("data", pa.binary()), ("text", pa.string())])


def _cut_out():
    def one(text: str | None, spans) -> dict:
        data, runs = (text or "").encode(), []
        for s, e in sorted((x["start"], x["stop"]) for x in spans or ()):
            if runs and s <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e])
        at, kept = 0, []
        for s, e in runs:
            kept.append(data[at:s])
            at = e
        left = b"".join([*kept, data[at:]]) if runs else data
        return {"n_bytes": len(data), "spans": [{"start": s, "stop": e} for s, e in runs], "data": left, "text": left.decode("utf-8", "replace") if runs else text or ""}

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, spans in batches:
            yield pa.array([one(t, s) for t, s in zip(text.to_pylist(), spans.to_pylist())], _KEPT)
    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "n_bytes long, spans array<struct<start: long, stop: long>>, data binary, text string").asNondeterministic()


@register("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, bytes and runs that went, and what stays, as a digest and as text."""
    out = without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("kept.spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "kept.n_bytes", removed.alias("n_removed"), F.size("kept.spans").cast("long").alias("n_spans"), F.sha2("kept.data", 256).alias("kept_sha256"), F.col("kept.text").alias("text"))
