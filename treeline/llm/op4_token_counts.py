"""Token counts of whole texts by a map-side two-tier lookup.

Tier one is a broadcast table: the lengths, in tokens, of the pieces that are
frequent in a bounded sample of texts.  Tier two is each worker's cache:
pieces that the table lacks are encoded once and remembered.  Counting is a
projection, so no pre-token and no text is ever shuffled.  The table changes
speed only, never a count.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import read, tokenizer_path
from treeline.llm.pretokens import LONGEST, PieceCache, load, spaced_pieces
from treeline.llm.registry import register

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
SAMPLE_CHARS = 10_000


def frequent_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, sample_docs: int = 1000,
                     entries: int = 20_000) -> tuple[list[str], bytes]:
    """Pieces most frequent in ``sample_docs`` texts, with their token counts.

    At most ``entries`` pieces of at most LONGEST characters bound the
    broadcast; the sample's texts are read up to SAMPLE_CHARS characters,
    which bounds what the driver sees.  Any sample is right, as the table is
    only a cache: texts are always counted whole.
    """
    sample = docs.select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).where("text <> ''").take(sample_docs)
    seen: Counter = Counter()
    for r in sample:
        seen.update(p for p in spaced_pieces(r.text) or () if len(p) <= LONGEST)
    best = [p for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:entries]]
    cache = PieceCache(load(tokenizer_path(vocabulary)), len, lambda p: " " + p)
    cache.learn(set(best))
    kept = [p for p in best if cache[p] < 256]
    return kept, bytes(cache[p] for p in kept)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, text: str = "text",
                 into: str = "tokens") -> DataFrame:
    """``docs`` with a struct column ``into``: n_bytes (UTF-8), n_tokens,
    over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens.  Every row of the input
    gives one row, repeated rows too; other columns are untouched.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs.select(F.col(text).alias("text")), vocabulary))
    arrow = pa.int64()

    def run(batches):
        pieces, lengths = table.value
        cache = PieceCache(load(tokenizer_path(vocabulary)), len, lambda p: " " + p, dict(zip(pieces, lengths)))
        for batch in batches:
            cut = [spaced_pieces(t) if t else [] for t in batch.to_pylist()]
            cache.learn(set().union(*(c for c in cut if c)))
            get = cache.__getitem__
            yield pa.array([cache.whole(t.as_py()) if c is None else sum(map(get, c)) for c, t in zip(cut, batch)], arrow)

    from collections.abc import Iterator

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    counted = docs.withColumn(into, F.arrow_udf(run, "long").asNondeterministic()(F.col(text)))
    n_bytes = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    return counted.withColumn(into, F.struct(n_bytes.alias("n_bytes"), F.col(into).alias("n_tokens"),
                                             (F.col(into) > limit).alias("over_limit")))


@register("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "tokens.*")
