"""Benchmark decontamination by suffix arrays over shards of the corpus.

Every task builds, for each shard (one Arrow batch) of whole documents, a
suffix array over word positions and binary-searches every benchmark suffix
in it.  Positions that no benchmark window can match are left out of the
array exactly: their first words do not occur together in the benchmark.
Matches, their places and the longest verbatim match come out with the
document's own row, so no text is shuffled.  The benchmark is the query set;
it is broadcast in blocks of bounded size, however large it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.llm.common import read
from treeline.llm.registry import register

WINDOW = 10
#: Most bytes of benchmark text in one broadcast.
BLOCK_BYTES = 32 << 20

#: Fixed value: ASCII bytes that are part of words (0-9, a-z; A-Z are lower-cased); all others but bytes of non-ASCII characters separate words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class TestSuffixes:
    """Windows of benchmark items as rows of word ids: one row for each
    suffix that starts a window, cut at the window's length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window, self.vocab, self.names = window, {}, []
        rows, lengths, owner, place = [], [], [], []
        for name, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            if not ids:
                continue
            k = len(self.names)
            self.names.append(name)
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1):
                rows.append(ids[i:i + n] + [0] * (window - n))
                lengths.append(n)
                owner.append(k)
                place.append(i)
        self.rows = np.array(rows, np.uint32).reshape(-1, window)
        self.lengths, self.owner, self.place = (np.array(x, np.int64) for x in (lengths, owner, place))
        self.least = int(self.lengths.min()) if rows else 0
        self.heads = self._heads(self.rows)
        self.known_heads = np.unique(self.heads)
        self.low = self._keys(self.rows)
        high = self.rows.copy()
        high[np.arange(window)[None, :] >= self.lengths[:, None]] = 0xFFFFFFFF
        self.high = self._keys(high)

    def _heads(self, rows: np.ndarray) -> np.ndarray:
        """What starts a window: its first two words, or one where some window has no more."""
        first = rows[:, 0].astype(np.int64) if len(rows) else np.zeros(0, np.int64)
        return first * (len(self.vocab) + 1) + rows[:, 1] if self.least >= 2 and self.window >= 2 else first

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        """Rows as byte strings in the order of their ids."""
        return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * self.window}").reshape(-1)

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, test suffix) of every occurrence in a shard.  ids: word
        ids of the shard, 0 for unknown words and between documents."""
        none = np.zeros(0, np.int64)
        if not len(self.rows) or not len(ids):
            return none, none
        padded = np.concatenate([ids, np.zeros(self.window, ids.dtype)])
        known = padded[:len(ids)] > 0
        start = np.flatnonzero(known)
        if self.least >= 2 and self.window >= 2:
            start = start[padded[start + 1] > 0]
            head = padded[start].astype(np.int64) * (len(self.vocab) + 1) + padded[start + 1]
        else:
            head = padded[start].astype(np.int64)
        start = start[np.isin(head, self.known_heads)]
        for k in range(2, self.least):
            start = start[padded[start + k] > 0]
        if not len(start):
            return none, none
        suffixes = padded[start[:, None] + np.arange(self.window)]
        keys = self._keys(suffixes)
        order = np.argsort(keys, kind="stable")
        array, keys = start[order], keys[order]
        asked = np.flatnonzero(np.isin(self.heads, self._heads(suffixes)))
        lo = np.searchsorted(keys, self.low[asked], side="left")
        hi = np.searchsorted(keys, self.high[asked], side="right")
        n = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(asked)), n)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return array[lo[which] + offset], asked[which]


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _matched(texts: list[str | None], before: list[dict | None], tests: TestSuffixes) -> list[dict]:
    get = tests.vocab.get
    parts = [[get(w, 0) for w in words(t)] for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    ids = np.zeros(starts[-1], np.uint32)
    for s, p in zip(starts, parts):
        ids[s:s + len(p)] = p
    at, test = tests.search(ids)
    order = np.argsort(at, kind="stable")
    at, test = at[order], test[order]
    cut = np.searchsorted(at, starts)
    out = []
    for k, p in enumerate(parts):
        old = before[k] or {"spans": [], "items": [], "longest": 0}
        a, q = at[cut[k]:cut[k + 1]] - starts[k], test[cut[k]:cut[k + 1]]
        spans, items, longest = old["spans"], old["items"], old["longest"]
        if len(a):
            edge = np.zeros(len(p) + 1, np.int64)
            np.add.at(edge, a, 1)
            np.add.at(edge, a + tests.lengths[q], -1)
            for s in spans:
                edge[s["start"]] += 1
                edge[s["stop"]] -= 1
            spans = [{"start": s, "stop": e} for s, e in _runs(np.cumsum(edge[:-1]) > 0)]
            items = sorted({*items, *(tests.names[i] for i in np.unique(tests.owner[q]) if tests.names[i] is not None)})
            # windows that follow each other in text and item make one longer match
            by = np.lexsort((a, a - tests.place[q], tests.owner[q]))
            a, q = a[by], q[by]
            follows = (np.diff(a) == 1) & (np.diff(tests.place[q]) == 1) & (np.diff(tests.owner[q]) == 0)
            run = max((e - s for s, e in _runs(follows)), default=0)
            longest = max(longest, run + int(tests.lengths[q].max()))
        out.append({"n_words": len(p), "spans": spans, "items": items, "longest": longest})
    return out


_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                    ("items", pa.list_(pa.string())), ("longest", pa.int64())])
_SCHEMA = "n_words long, spans array<struct<start: long, stop: long>>, items array<string>, longest long"


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, into: str = "leak") -> DataFrame:
    """``docs`` (text) with a struct column ``into``: n_words, spans (maximal
    runs of hit words, stop exclusive), items (ids of the items with
    occurring windows, as sorted strings), longest (words of the longest
    verbatim match).

    ``benchmark``: item_id, text.  A window is ``window`` consecutive words of
    an item; an item of fewer words is one window; an item without words (or
    null) is none.  Null and empty documents have no words.  A null item_id
    marks words but isn't listed; repeated items and documents are handled
    row by row.  Other columns are untouched.  An empty benchmark hits
    nothing.
    """
    spark = docs.sparkSession
    b = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = docs.withColumn(into, F.lit(None).cast(T.StructType.fromDDL(_SCHEMA)))
    for k in range(blocks):
        items = [(r.item_id, r.text) for r in b.where(key == k).orderBy("item_id", "text").collect()]
        out = out.withColumn(into, _block(spark.sparkContext.broadcast(items), window)("text", into))
    return out


def _block(items, window: int):
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tests = TestSuffixes(items.value, window)
        for text, before in batches:
            yield pa.array(_matched(text.to_pylist(), before.to_pylist(), tests), _ARROW)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, _SCHEMA).asNondeterministic()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a word in any benchmark window; columns unchanged."""
    return benchmark_matches(docs, benchmark, window, "__leak").where(F.size("__leak.spans") == 0).drop("__leak")


_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
          " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
found AS (SELECT p.doc_id, p.i, p.n, item_id FROM places p JOIN windows v
  ON p.n = v.n AND array_to_string(list_slice(p.w, p.i, p.i + p.n - 1), ' ') = v.s),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@register("op10_decontamination", SQL)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_matches(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("leak.spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "leak.n_words", hit.alias("n_hit"), F.size("leak.items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("leak.items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.size("leak.spans") > 0).alias("contaminated"))
