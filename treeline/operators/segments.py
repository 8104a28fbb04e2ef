"""The stored full-text index (X1, X9, T5) and search on it.

An index is a folder of plain partitioned Parquet tables.  Documents are added
in segments that are never rewritten:

* ``postings/segment=s/bucket=b`` -- (token, doc_id, field, pos, dl), sorted by
  token inside a bucket.  The bucket is a hash of the token; a token with very
  many postings is dealt over several buckets by its documents' hash, so
  neither a writer nor a reader of a stop word is one task.
* ``tokens/segment=s`` -- the dictionary: token, df, postings, first bucket
  and number of buckets.
* ``documents/segment=s`` -- doc_id, dl, content_hash of what was indexed.
* ``vectors/segment=s`` -- embeddings of the same documents, where asked for.
* ``gone/segment=s`` -- documents of earlier segments that this one replaces
  or removes.
* ``stats/segment=s`` -- one row, written last: a segment without it doesn't
  count, and a second attempt overwrites it.

A refresh writes the changed documents' rows and nothing else.  Segments of
like size are merged into one, without tokenizing again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.operators import text_index
from treeline.session import discard, materialize, path_exists

#: Buckets of a segment's postings, and least postings of a token that is dealt over several.
BUCKETS, HEAVY = 16, 100_000
#: Segments of one size tier (powers of this) that are merged.
TIER = 4
#: Postings that a task sorts into a new segment's buckets; they fit its memory.
TASK_POSTINGS = 4_000_000
#: Most documents of the rarest token that are broadcast; the dictionary knows their number.
BROADCAST_IDS = 1_000_000

TABLES = {
    "postings": "token string, doc_id long, field int, pos int, dl long, segment int, bucket int",
    "tokens": "token string, df long, postings long, home int, spread int, segment int",
    "documents": "doc_id long, dl long, content_hash string, segment int",
    "gone": "doc_id long, dl long, of int, segment int",
}


@dataclass(frozen=True)
class Segment:
    id: int
    postings: int
    documents: int
    length: int
    buckets: int
    replaces: tuple[int, ...]


def _table(spark: SparkSession, path: str, name: str, segments: Iterable[int]) -> DataFrame:
    """Rows of a table's given segments; the others' folders are pruned."""
    if not path_exists(spark, f"{path}/{name}"):
        return spark.createDataFrame([], TABLES[name])
    return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}").where(F.col("segment").isin(list(segments)))


def committed(spark: SparkSession, path: str) -> list[Segment]:
    """All complete segments, merged ones included."""
    if not path_exists(spark, f"{path}/stats"):
        return []
    rows = spark.read.parquet(f"{path}/stats").collect()
    return sorted((Segment(r.segment, r.postings, r.documents, r.length, r.buckets, tuple(r.replaces)) for r in rows), key=lambda s: s.id)


def visible(segments: list[Segment]) -> list[Segment]:
    replaced = {x for s in segments for x in s.replaces}
    return [s for s in segments if s.id not in replaced]


def _gone(spark: SparkSession, path: str, segments: list[Segment]) -> DataFrame:
    """(of, doc_id, dl): documents of visible segments that a later one replaced."""
    return _table(spark, path, "gone", [s.id for s in segments]).where(
        F.col("of").isin([s.id for s in visible(segments)])).select("of", "doc_id", "dl").distinct()


def _live(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select(F.col("of").alias("segment"), "doc_id"), ["segment", "doc_id"], "left_anti")


def current(spark: SparkSession, path: str, name: str = "documents") -> DataFrame:
    """The index's live rows of a table: ``documents``, ``postings`` or ``vectors``."""
    segments = committed(spark, path)
    shown = [s.id for s in visible(segments)]
    if name == "vectors":
        rows = spark.read.parquet(f"{path}/vectors").where(F.col("segment").isin(shown))
    else:
        rows = _table(spark, path, name, shown)
    return _live(rows, _gone(spark, path, segments)).drop("segment", "bucket")


def _write(rows: DataFrame, path: str, name: str, segment: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{name}/segment={segment}")


def _pair_counts(rows: DataFrame) -> DataFrame:
    """(token, df, postings) of posting rows."""
    return rows.groupBy("token", "doc_id").agg(F.count("*").alias("n")).groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("postings"))


def _write_postings(rows: DataFrame, path: str, segment: int, buckets: int, heavy: int, counts: DataFrame | None = None) -> int:
    """Writes token rows as a segment's postings and dictionary.  ``counts``
    (token, df, postings): known counts; otherwise the rows are read for them.
    ``rows`` may also be token arrays: then documents are dealt to tasks, and
    each sorts its own into the buckets, so token rows aren't shuffled."""
    counts = materialize(counts if counts is not None else _pair_counts(rows), "stage")
    home = F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")
    total = counts.agg(F.coalesce(F.sum("postings"), F.lit(0))).first()[0]
    # at most four tokens for each bucket can be over this share, so the list that is sent to the tasks is short
    share = max(heavy, total // (4 * buckets))
    tokens = counts.select("token", "df", "postings", home.alias("home"), F.least(F.ceil(F.col("postings") / share), F.lit(buckets)).cast("int").alias("spread"))
    _write(tokens.sort("token"), path, "tokens", segment)
    by_document = "token" not in rows.columns
    if by_document:
        # a small segment is still spread over the cores
        cores = rows.sparkSession.sparkContext.defaultParallelism
        tasks = max(1, -(-total // TASK_POSTINGS), min(cores, total // 500_000))
        rows = text_index.posting_rows(rows.repartition(tasks, "doc_id"))
    dealt = rows.join(F.broadcast(tokens.where("spread > 1").select("token", "spread")), "token", "left")
    bucket = F.pmod(home + F.pmod(F.xxhash64("doc_id"), F.coalesce("spread", F.lit(1))), F.lit(buckets)).cast("int")
    # field and position travel as one number, which also sorts as they do
    place = F.shiftleft(F.col("field").cast("long"), 32) + F.col("pos")
    dealt = dealt.select("token", "doc_id", place.alias("_place"), "dl", bucket.alias("bucket"))
    ((dealt if by_document else dealt.hint("rebalance", "bucket")).sortWithinPartitions("bucket", "token", "doc_id", "_place")
     .select("token", "doc_id", F.shiftright("_place", 32).cast("int").alias("field"), F.col("_place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos"), "dl", "bucket")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/segment={segment}"))
    return total


def _commit(spark: SparkSession, path: str, segment: int, postings: int, buckets: int, replaces: list[int]) -> Segment:
    r = _table(spark, path, "documents", [segment]).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    row = [(postings, r[0], r[1], buckets, replaces)]
    spark.createDataFrame(row, "postings long, documents long, length long, buckets int, replaces array<int>").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/stats/segment={segment}")
    return Segment(segment, postings, r[0], r[1], buckets, tuple(replaces))


def add_segment(spark: SparkSession, path: str, docs: DataFrame, id_col: str = "doc_id", fields=("text",), removed: DataFrame | None = None,
                segment: int | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS, heavy: int = HEAVY) -> Segment:
    """Indexes ``docs`` (one row for each id) as a new segment, in which they
    replace earlier versions; ``removed`` (doc_id): documents to drop.

    ``segment``: number to write, the next one by default (a stream gives its
    batch's, so that a replayed batch overwrites what it wrote before).
    ``embed``: turns the documents into vector rows (doc_id, embedding, ...).
    Null ids are ignored; texts that are null have no tokens.
    """
    before = [s for s in committed(spark, path) if segment is None or s.id < segment]
    segment = segment if segment is not None else max([s.id for s in before], default=0) + 1
    docs = docs.where(F.col(id_col).isNotNull())
    hashed = docs.withColumn("_hash", text_index.content_hash(fields))
    # the texts are read and tokenized once, and written as token arrays: a row for each document, not for each token
    arrays = materialize(text_index.token_arrays(hashed, id_col, fields, ["_hash"]), "stage")
    postings = _write_postings(arrays.drop("_hash"), path, segment, buckets, heavy, text_index.token_counts(arrays))
    length = F.max("dl").over(Window.partitionBy("doc_id"))
    _write(arrays.select("doc_id", length.alias("dl"), F.col("_hash").alias("content_hash")), path, "documents", segment)
    discard(arrays)
    if embed is not None:
        _write(embed(docs), path, "vectors", segment)
    ids = _table(spark, path, "documents", [segment]).select("doc_id")
    if removed is not None:
        ids = ids.union(removed.select(F.col("doc_id").cast("long")))
    old = _live(_table(spark, path, "documents", [s.id for s in visible(before)]), _gone(spark, path, before))
    _write(old.join(ids.distinct(), "doc_id", "left_semi").select("doc_id", "dl", F.col("segment").alias("of")), path, "gone", segment)
    return _commit(spark, path, segment, postings, buckets, [])


def refresh(spark: SparkSession, path: str, docs: DataFrame, id_col: str = "doc_id", fields=("text",), **options) -> Segment | None:
    """Brings the index up to ``docs``, the whole table.  Documents whose
    content hash is new go into one segment, ids that are gone are dropped
    with it.  None if nothing changed."""
    state = materialize(current(spark, path).select("doc_id", "content_hash"), "stage")
    todo = materialize(text_index.needs_index(docs, state, id_col, fields).where("needs_index and doc_id is not null").select("doc_id"), "stage")
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    removed = materialize(state.select("doc_id").join(ids, "doc_id", "left_anti"), "stage")
    if not todo.limit(1).count() and not removed.limit(1).count():
        return None
    changed = docs.join(todo.select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
    return add_segment(spark, path, changed, id_col, fields, removed, **options)


def merge(spark: SparkSession, path: str, buckets: int = BUCKETS, heavy: int = HEAVY, tier: int = TIER) -> list[Segment]:
    """Size-tiered merge: as long as ``tier`` visible segments lie in one tier
    (powers of ``tier`` in postings), they become one.  Live rows are copied,
    no text is read.  Returns the new segments; the old ones stay until
    :func:`vacuum`."""
    made = []
    while True:
        segments = committed(spark, path)
        tiers: dict[int, list[Segment]] = {}
        for s in visible(segments):
            n, k = s.postings, 0
            while n >= tier:
                n, k = n // tier, k + 1
            tiers.setdefault(k, []).append(s)
        full = next((t for _, t in sorted(tiers.items()) if len(t) >= tier), None)
        if full is None:
            return made
        old, new = [s.id for s in full], max(s.id for s in segments) + 1
        gone = _gone(spark, path, segments)
        rows, counts = _table(spark, path, "postings", old), _table(spark, path, "tokens", old).select("token", "df", "postings")
        if gone.where(F.col("of").isin(old)).limit(1).count():
            # a live document is in one segment, so the dictionaries add up once its gone documents are taken off
            lost = rows.join(gone.select(F.col("of").alias("segment"), "doc_id"), ["segment", "doc_id"], "left_semi")
            lost = lost.groupBy("segment", "token", "doc_id").agg(F.count("*").alias("n")).groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("postings"))
            rows, counts = _live(rows, gone), counts.unionByName(lost.select("token", -F.col("df"), -F.col("postings")).toDF("token", "df", "postings"))
        counts = counts.groupBy("token").agg(F.sum("df").alias("df"), F.sum("postings").alias("postings")).where("postings > 0")
        postings = _write_postings(rows.select("doc_id", "field", "pos", "token", "dl"), path, new, buckets, heavy, counts)
        _write(_live(_table(spark, path, "documents", old), gone).drop("segment"), path, "documents", new)
        if path_exists(spark, f"{path}/vectors"):
            _write(_live(spark.read.parquet(f"{path}/vectors").where(F.col("segment").isin(old)), gone).drop("segment"), path, "vectors", new)
        made.append(_commit(spark, path, new, postings, buckets, old))


def vacuum(spark: SparkSession, path: str) -> list[int]:
    """Deletes the files of merged segments (their stats and gone rows stay)."""
    segments = committed(spark, path)
    shown = {s.id for s in visible(segments)}
    merged = [s.id for s in segments if s.id not in shown]
    sc = spark.sparkContext
    for s in merged:
        for name in ("postings", "tokens", "documents", "vectors"):
            p = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/segment={s}")
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    return merged


def hits(spark: SparkSession, path: str, phrase: list[str]) -> DataFrame:
    """Live postings (doc_id, field, pos, token, dl) of a phrase's tokens in
    documents that hold them all.

    The dictionary gives each token's document count and buckets.  The rarest
    token's documents are found first; every further token's postings are
    reduced to the documents left, so a stop word beside a rare token sends
    few rows.  Only the tokens' buckets are read.
    """
    segments = committed(spark, path)
    shown = {s.id: s for s in visible(segments)}
    found: dict[str, list] = {t: [] for t in phrase}
    for r in _table(spark, path, "tokens", shown).where(F.col("token").isin(sorted(found))).collect():
        found[r.token].append(r)
    empty = spark.createDataFrame([], "doc_id long, field int, pos int, token string, dl long")
    if not phrase or not all(found.values()):
        return empty
    postings, gone = _table(spark, path, "postings", shown), _gone(spark, path, segments)
    some_gone = gone.limit(1).count() > 0

    def of(token: str) -> DataFrame:
        places = F.lit(False)
        for r in found[token]:
            n = shown[r.segment].buckets
            places = places | ((F.col("segment") == r.segment) & F.col("bucket").isin([(r.home + k) % n for k in range(r.spread)]))
        rows = postings.where(places & (F.col("token") == token))
        return (_live(rows, gone) if some_gone else rows).select("doc_id", "field", "pos", "token", "dl")
    df = {t: sum(r.df for r in rows) for t, rows in found.items()}
    out = ids = None
    for token in sorted(df, key=lambda t: (df[t], t)):
        rows = of(token)
        if ids is not None:
            rows = rows.join(F.broadcast(ids) if least <= BROADCAST_IDS else ids, "doc_id", "left_semi")
        else:
            least = df[token]
        ids = rows.select("doc_id").distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def corpus_stats(spark: SparkSession, path: str) -> DataFrame:
    """Single row ``n_docs, avgdl`` of the live documents, from the segments' own counts."""
    segments = committed(spark, path)
    gone = _gone(spark, path, segments).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    n = sum(s.documents for s in visible(segments)) - gone[0]
    length = sum(s.length for s in visible(segments)) - gone[1]
    return spark.range(1).select(F.lit(n).cast("long").alias("n_docs"), F.lit(length / n if n else None).cast("double").alias("avgdl"))


def phrase_search(spark: SparkSession, path: str, query: str, limit: int = 20, phrase: list[str] | None = None) -> DataFrame:
    """X2 on the stored index: best ``limit`` documents for the phrase, score desc then id."""
    toks = phrase if phrase is not None else text_index.query_tokens(query)
    matched = materialize(text_index.phrase_tf(hits(spark, path, toks), toks))
    return text_index.bm25(matched, corpus_stats(spark, path)).orderBy(F.desc("score"), F.asc("doc_id")).limit(limit)
