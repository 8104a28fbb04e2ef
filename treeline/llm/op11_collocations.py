"""Phrase collocations by SON partitioning.

A phrase that occurs ``support`` times in the corpus occurs at least
``support / SHARDS`` times in one of SHARDS parts of it.  So the first phase
mines every shard completely at that local support, level by level: the words
that are frequent in a shard, then the pairs of such words, then the triples
of such pairs.  It counts 64-bit keys of phrases; two phrases that share a key
only make each other likelier to be a candidate.  The second phase counts the
union of what any shard found over all texts, now as strings, exactly.

What a level leaves is shipped as a bitmap of fixed size (FILTER_BITS).  A bit
that two keys share lets a phrase through that the next count then drops, so
a full bitmap costs time and never a phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm.common import materialize, read
from treeline.llm.registry import register

#: Occurrences and words of a phrase, share (in per cent) of it that a longer one may hold, rows of a language.
SUPPORT, MAX_WORDS, HELD_PERCENT, TOP = 10, 3, 50, 2000
#: Parts of the corpus that are mined apart; a power of two, as its number takes the top bits of a key.
SHARDS = 4
#: Bits of a shipped filter: 16 MB at any size of the corpus.
FILTER_BITS = 1 << 27
#: Bits of a row of a filter while it is made (what Spark's bitmap functions fix).
ROW_BITS = 1 << 15
#: Bytes of text that a task looks at together; longer texts are parted between two pieces.
CHUNK_BYTES = 8 << 20
#: Groups that a language's ranking is prepared in.
SALTS = 64

#: A-Z in lower case, the ends of pieces as line feeds, the ends of words as spaces.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts, one entry for each occurrence: ``code`` (of the
    word in ``kinds``), ``piece``, ``owner`` (which text)."""

    def __init__(self, texts: list[bytes]):
        a = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        inside = (a != 32) & (a != 10)
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        start, stop = edges[::2], edges[1::2]
        offsets = np.zeros(len(start) + 1, np.int64)
        np.cumsum(stop - start, out=offsets[1:])
        flat = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(a[inside])])
        coded = flat.dictionary_encode()
        self.kinds, self.code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.piece = np.searchsorted(np.flatnonzero(a == 10), start)
        first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        self.owner = np.searchsorted(first, start, side="right") - 1

    def keys(self, salt: np.ndarray) -> np.ndarray:
        """A 64-bit key of every occurrence's word and of its text's ``salt``."""
        h = np.array([xxhash.xxh64_intdigest(w) for w in self.kinds.to_pylist()], np.uint64)
        return _mix(h[self.code] + salt[self.owner])

    def starts(self, size: int) -> np.ndarray:
        """Places at which a phrase of so many words begins and ends in one piece."""
        n = len(self.code) - size + 1
        return np.flatnonzero(self.piece[:n] == self.piece[size - 1:]) if n > 0 else np.zeros(0, np.int64)


def _longer(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of phrases with one word more."""
    return _mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def phrase_keys(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Keys of the phrases of ``size`` words that begin ``at`` these places."""
    out = words[at]
    for k in range(1, size):
        out = _longer(out, words[at + k])
    return out


def _in_shard(keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Keys with the shard's number as their top bits."""
    bits = SHARDS.bit_length() - 1
    return (keys >> np.uint64(bits)) | (shard.astype(np.uint64) << np.uint64(64 - bits))


def _anywhere(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(SHARDS.bit_length() - 1)


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys ^ (keys >> np.uint64(40))) & np.uint64(FILTER_BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def filter_of(keys: DataFrame) -> np.ndarray:
    """A bitmap that holds every ``key`` of the table; its parts are made by Spark."""
    at = F.col("key").bitwiseXOR(F.shiftrightunsigned("key", 40)).bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = (keys.select(F.shiftright(at, 15).alias("row"), at.bitwiseAND(F.lit(ROW_BITS - 1)).alias("bit"))
            .groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).collect())
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        out[r.row * ROW_BITS // 8:(r.row + 1) * ROW_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end between two pieces."""
    at = 0
    while len(text) - at > CHUNK_BYTES:
        cut = text.rfind(b"\n", at, at + CHUNK_BYTES)
        cut = cut if cut >= at else text.find(b"\n", at + CHUNK_BYTES)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str], np.ndarray]]:
    """Texts, their languages and shards, so many that they fit a task."""
    texts, langs, shards, size = [], [], [], 0
    for b in batches:
        for text, lang, shard in zip(b["text"].cast(pa.binary()).to_pylist(), b["lang"].to_pylist(), b["shard"].to_pylist()):
            for part in _parts((text or b"").translate(_PLAIN)):
                texts.append(part)
                langs.append(lang)
                shards.append(shard)
                size += len(part)
                if size >= CHUNK_BYTES:
                    yield texts, langs, np.array(shards)
                    texts, langs, shards, size = [], [], [], 0
    if texts:
        yield texts, langs, np.array(shards)


def _salts(langs: list[str]) -> np.ndarray:
    of = {x: xxhash.xxh64_intdigest(x) for x in set(langs)}
    return np.array([of[x] for x in langs], np.uint64)


def _mined(size: int, shorter):
    """Counts of the keys of phrases of ``size`` words whose shorter phrases
    are frequent in the shard (``shorter``: broadcast filter, none for words)."""
    def run(batches):
        for texts, langs, shards in _chunks(batches):
            w = Words(texts)
            words, at = w.keys(_salts(langs)), w.starts(size)
            if size > 1:
                for side in (0, 1):
                    at = at[_passes(shorter.value, _in_shard(phrase_keys(words, at + side, size - 1), shards[w.owner[at]]))]
            keys, n = np.unique(_in_shard(phrase_keys(words, at, size), shards[w.owner[at]]), return_counts=True)
            for k in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k:k + (1 << 16)].view(np.int64)), pa.array(n[k:k + (1 << 16)])], ["key", "n"])
    return run


def mine_shards(dealt: DataFrame, support: int = SUPPORT, max_words: int = MAX_WORDS) -> DataFrame:
    """``key, n`` of every phrase of up to ``max_words`` words that reaches the
    lowered support in a shard.  ``dealt``: text, lang, shard."""
    context, found, shorter = dealt.sparkSession.sparkContext, None, None
    for size in range(1, max_words + 1):
        level = (dealt.mapInArrow(_mined(size, shorter), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
                 .where(F.col("n") * SHARDS >= support))
        level = materialize(level, "stage")
        found = level if found is None else found.union(level)
        if size < max_words:
            shorter = context.broadcast(filter_of(level))
    return found


def _counted(max_words: int, wanted):
    """Exact counts, as strings, of the phrases that the filter lets through,
    and of all words of a language (size 0)."""
    def run(batches):
        for texts, langs, _ in _chunks(batches):
            w = Words(texts)
            kinds, words = sorted(set(langs)), w.keys(_salts(langs))
            names, lang = pa.array(kinds, pa.string()), np.searchsorted(np.array(kinds, object), np.array(langs, object))[w.owner]
            total = np.bincount(lang, minlength=len(kinds)) if len(lang) else np.zeros(len(kinds), np.int64)
            yield pa.RecordBatch.from_arrays([names, pa.array(np.zeros(len(kinds), np.int32)), pa.array([""] * len(kinds), pa.string()), pa.array(total)], _COUNTS)
            code, width = w.code * len(kinds) + lang, max(1, len(w.kinds) * len(kinds))
            for size in range(1, max_words + 1):
                at = w.starts(size)
                at = at[_passes(wanted.value, _anywhere(phrase_keys(words, at, size)))]
                group = code[at]  # a number for each different phrase, one word at a time
                for k in range(1, size):
                    group = np.unique(group, return_inverse=True)[1] * width + code[at + k]
                _, first, n = np.unique(group, return_index=True, return_counts=True)
                for k in range(0, len(first), 1 << 16):
                    place = at[first[k:k + (1 << 16)]]
                    phrase = pc.binary_join_element_wise(*[w.kinds.take(pa.array(w.code[place + j])) for j in range(size)], pa.scalar(b" ", pa.large_binary()))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[place])), pa.array(np.full(len(place), size, np.int32)),
                                                      phrase.cast(pa.binary()).view(pa.string()), pa.array(n[k:k + (1 << 16)])], _COUNTS)
    return run


_COUNTS = ["lang", "size", "phrase", "f"]


def count_candidates(dealt: DataFrame, found: DataFrame, support: int = SUPPORT, max_words: int = MAX_WORDS) -> DataFrame:
    """``lang, size, phrase, f`` of every word and phrase that occurs
    ``support`` times, counted over all texts; size 0: all words of the language."""
    bits = SHARDS.bit_length() - 1
    keys = found.select(F.col("key").bitwiseAND(F.lit((1 << (64 - bits)) - 1)).alias("key"))
    wanted = dealt.sparkSession.sparkContext.broadcast(filter_of(keys))
    return (dealt.mapInArrow(_counted(max_words, wanted), "lang string, size int, phrase string, f long")
            .groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where((F.col("size") == 0) | (F.col("f") >= support)))


def _words(first: Column, n: Column) -> Column:
    return F.array_join(F.slice("words", first, n), " ")


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, score``: every phrase at its lowest-scoring cut."""
    part = counts.where("size >= 1")
    phrases = counts.where("size >= 2").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"), "size")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _words(F.lit(1), F.col("k")).alias("first"), _words(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    both = (cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    # products of counts as decimals of 38 digits: whole numbers throughout
    score = F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    return (both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
            .select("lang", "phrase", "a", "x.l", "x.r", "x.score"))


def held_by_longer(counts: DataFrame, percent: int = HELD_PERCENT) -> DataFrame:
    """``lang, phrase`` of the phrases that lie in a longer one often enough."""
    longer = counts.where("size >= 3").select("lang", "f", "size", F.split("phrase", " ").alias("words"))
    inner = (longer.withColumn("n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
             .withColumn("i", F.explode(F.expr("sequence(1, size - n + 1)")))
             .select("lang", _words(F.col("i"), F.col("n")).alias("phrase"), "f"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return (counts.where("size >= 2").select("lang", "phrase", "f").join(inner, ["lang", "phrase"])
            .where(F.lit(100).cast("decimal(3,0)") * F.col("most") >= F.lit(percent).cast("decimal(3,0)") * F.col("f")).select("lang", "phrase"))


def collocations(docs: DataFrame, support: int = SUPPORT, max_words: int = MAX_WORDS, percent: int = HELD_PERCENT, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases.

    ``docs``: text, lang and whatever else.  A null text is empty, a null lang
    is ``und``.  Texts are lower-cased (A-Z), parted into pieces at
    ``.,;:!?`` and line ends, and pieces into words at spaces and tabs.
    Repeated rows count as often as they are there; an empty table gives an
    empty one; equal scores are ordered by count, then by phrase.
    """
    salt = F.pmod(F.xxhash64("text"), F.lit(SHARDS)) if "doc_id" not in docs.columns else F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARDS))
    dealt = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), salt.cast("int").alias("shard"))
    counts = materialize(count_candidates(dealt, mine_shards(dealt, support, max_words), support, max_words), "stage")
    kept = scored(counts).join(held_by_longer(counts, percent), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, 1 AS size, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, ws[i] || ' ' || ws[i + 1] FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM w)
  UNION ALL SELECT lang, 3, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS x FROM f WHERE size > 1 AND f >= 10),
cut AS (
  SELECT lang, size, phrase, a, 1 AS k, x[1] AS first, array_to_string(x[2:], ' ') AS rest FROM c
  UNION ALL SELECT lang, size, phrase, a, 2, x[1] || ' ' || x[2], x[3] FROM c WHERE size = 3),
s AS (
  SELECT cut.lang, cut.size, cut.phrase, a, k, u.f AS l, v.f AS r,
         ((1000000::HUGEINT * a * a) // (u.f::HUGEINT * v.f))::BIGINT AS score
  FROM cut JOIN f u ON u.lang = cut.lang AND u.phrase = cut.first AND u.size = k
           JOIN f v ON v.lang = cut.lang AND v.phrase = cut.rest AND v.size = cut.size - k),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner2 AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, x[1] || ' ' || x[2] AS phrase, a FROM c WHERE size = 3
    UNION ALL SELECT lang, x[2] || ' ' || x[3], a FROM c WHERE size = 3) GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN inner2 i ON i.lang = best.lang AND i.phrase = best.phrase AND best.size = 2
  WHERE i.most IS NULL OR 100 * i.most < 50 * best.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n.n AS n, score
FROM kept JOIN n USING (lang)
QUALIFY rank <= 2000
"""


@register("op11_collocations", SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 collocations of two or three words over all documents."""
    return collocations(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
