"""Full-text postings (X1) and phrase search with BM25 ranking.

* ``postings(doc_id, field, pos, token, dl)`` -- one row per token
  occurrence.  ``dl`` (the document's token count over all fields) is
  carried on every posting so a search never joins back to the document
  table.
* ``doc_stats(doc_id, dl)`` -- one row per indexed document, including
  documents without tokens; gives N and the average length.

How they are stored, refreshed and searched is in :mod:`treeline.operators.segments`.

A phrase query is answered from postings alone: every posting of a query
token votes for the phrase start ``pos - offset``; a start that collects
all offsets is one phrase occurrence.  That replaces the k-way self join
on positions with a single aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions import fixed

# Token boundary: anything that is not a letter or a digit.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(col: Column) -> Column:
    """Lower-cased letter/digit runs of a text column, empty runs removed.

    ``array_remove`` instead of a lambda filter: higher-order functions are
    interpreted per element, built-in array functions are code-generated.
    """
    return F.array_remove(F.split(F.lower(F.coalesce(col, F.lit(""))), TOKEN_SPLIT), "")


def query_tokens(text: str) -> list[str]:
    """Tokenise a (short, driver-side) query string with the same rule."""
    import regex

    return [t for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t]


def token_arrays(docs: DataFrame, id_col: str = "doc_id", fields=("text",), keep=()) -> DataFrame:
    """(doc_id, dl, *keep, _t0, _t1, ...): the tokens of each field and their number over all fields."""
    fields = list(fields)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep,
                    *[tokens(F.col(f)).alias(f"_t{k}") for k, f in enumerate(fields)])
    dl = F.lit(0)
    for k in range(len(fields)):
        dl = dl + F.size(f"_t{k}")
    # dl is computed *before* the generator: referenced next to posexplode it
    # would keep the whole token array on every exploded row.
    return d.select("doc_id", dl.cast("long").alias("dl"), *keep, *[f"_t{k}" for k in range(len(fields))])


def posting_rows(arrays: DataFrame) -> DataFrame:
    """(doc_id, field, pos, token, dl): one row per token occurrence of
    :func:`token_arrays`.

    Two generators (fields, then positions) and no lambdas, so the whole
    pipeline stays in generated code.
    """
    n = sum(c.startswith("_t") for c in arrays.columns)
    if n == 1:
        return (arrays.select("doc_id", "dl", F.lit(0).alias("field"), F.posexplode("_t0").alias("pos", "token"))
                .select("doc_id", "field", "pos", "token", "dl"))
    per = F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"_t{k}").alias("t")) for k in range(n)])
    f = arrays.select("doc_id", "dl", F.explode(per).alias("f"))
    f = f.select("doc_id", "dl", F.col("f.field").alias("field"), F.col("f.t").alias("t"))
    return (f.select("doc_id", "dl", "field", F.posexplode("t").alias("pos", "token"))
            .select("doc_id", "field", "pos", "token", "dl"))


def token_counts(arrays: DataFrame) -> DataFrame:
    """(token, df, postings) of :func:`token_arrays`.  A document's different
    tokens are found in its own array, so what is grouped is tokens, never
    (token, document) pairs."""
    words = F.concat(*[F.col(c) for c in arrays.columns if c.startswith("_t")])
    once = arrays.select(F.explode(F.array_distinct(words)).alias("token"), F.lit(1).alias("df"), F.lit(0).alias("n"))
    each = arrays.select(F.explode(words).alias("token"), F.lit(0).alias("df"), F.lit(1).alias("n"))
    return once.unionByName(each).groupBy("token").agg(F.sum("df").alias("df"), F.sum("n").alias("postings"))


def build_postings(docs: DataFrame, id_col: str = "doc_id", fields: list[str] | tuple[str, ...] = ("text",)) -> DataFrame:
    """Postings of the given text fields, positions counted per field."""
    return posting_rows(token_arrays(docs, id_col, fields))


_TOKEN_RUN = r"[\p{L}\p{N}]+"


def phrase_regex(phrase: list[str]) -> str:
    """Pattern matching each occurrence of the phrase: its first token as a
    whole letter/digit run, followed (lookahead) by the remaining tokens
    separated by non-token characters only.  Only the first token is
    consumed, so overlapping occurrences all count, like positional
    postings do; the literal first token lets the matcher skip ahead."""
    import re

    head, rest = re.escape(phrase[0]), [re.escape(t) for t in phrase[1:]]
    tail = "".join(r"[^\p{L}\p{N}]+" + t for t in rest)
    return r"(?<![\p{L}\p{N}])" + head + r"(?=" + tail + r"(?![\p{L}\p{N}]))"


def phrase_counts(docs: DataFrame, phrase: list[str], id_col: str = "doc_id",
                  fields: list[str] | tuple[str, ...] = ("text",)) -> DataFrame:
    """Index-free scan form of X2's inputs: per document its length ``dl``
    (token count) and the phrase frequency ``tf``, both as regex counts on
    the lower-cased text -- no token arrays, no explode, no shuffle."""
    rx = phrase_regex(phrase)
    dl = F.lit(0)
    tf = F.lit(0)
    for f in fields:
        low = F.lower(F.coalesce(F.col(f), F.lit("")))
        dl = dl + F.regexp_count(low, F.lit(_TOKEN_RUN))
        tf = tf + F.regexp_count(low, F.lit(rx))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), dl.cast("long").alias("dl"), tf.cast("long").alias("tf"))


def phrase_search_scan(docs: DataFrame, query: str, limit: int = 20, id_col: str = "doc_id",
                       fields: list[str] | tuple[str, ...] = ("text",), phrase: list[str] | None = None) -> DataFrame:
    """X2 without a stored index: one regex pass for (dl, tf), BM25 over the
    matching documents, global N / avgdl / df from single-row aggregates."""
    toks = phrase if phrase is not None else query_tokens(query)
    if not toks:
        return docs.sparkSession.createDataFrame([], "doc_id long, tf long, dl long, score double")
    # (doc_id, dl, tf) is tiny next to the text; checkpoint it so the two
    # consumers (corpus stats, matching documents) do not scan the text twice.
    from treeline.session import materialize

    counts = materialize(phrase_counts(docs, toks, id_col, fields))
    stats = counts.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    hits = counts.where(F.col("tf") > 0).select("doc_id", "dl", "tf")
    return bm25(hits, stats).orderBy(F.desc("score"), F.asc("doc_id")).limit(limit)


def build_doc_stats(docs: DataFrame, id_col: str = "doc_id", fields: list[str] | tuple[str, ...] = ("text",)) -> DataFrame:
    """Per-document token count over all fields (documents without tokens keep dl = 0)."""
    dl = reduce(lambda a, b: a + b, [F.size(tokens(F.col(f))) for f in fields])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), dl.cast("long").alias("dl"))


def corpus_stats(doc_stats: DataFrame) -> DataFrame:
    """Single row: number of documents and average length."""
    return doc_stats.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def phrase_tf(postings: DataFrame, phrase: list[str]) -> DataFrame:
    """Occurrences of the phrase (adjacent tokens inside one field) per document.

    Returns ``(doc_id, dl, tf)`` for documents holding the phrase at least once.
    """
    n = len(phrase)
    if n == 0:
        return postings.sparkSession.createDataFrame([], "doc_id long, dl long, tf long")
    distinct = sorted(set(phrase))
    hits = postings.where(F.col("token").isin(distinct))
    if n == 1:
        return hits.groupBy("doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    # offsets at which each token sits inside the phrase
    offsets = None
    for t in distinct:
        arr = F.array(*[F.lit(i) for i, q in enumerate(phrase) if q == t])
        offsets = F.when(F.col("token") == t, arr) if offsets is None else offsets.when(F.col("token") == t, arr)
    starts = (hits.select("doc_id", "dl", "field", "pos", F.explode(offsets).alias("off"))
              .select("doc_id", "dl", "field", (F.col("pos") - F.col("off")).alias("start")))
    occurrences = (
        starts.groupBy("doc_id", "dl", "field", "start")
        .agg(F.count(F.lit(1)).alias("k"))
        .where(F.col("k") == n)
    )
    return occurrences.groupBy("doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25(tf: DataFrame, stats: DataFrame, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B) -> DataFrame:
    """Attach the BM25 score of a single phrase (higher is better).

    idf = ln((N - df + 0.5) / (df + 0.5)), replaced by 1e-6 when not positive.
    ``stats`` is the single-row corpus summary; ``df`` is the number of
    matching documents.  Both are one-row frames joined by broadcast.
    """
    df_count = tf.agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl"))
    score = idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + norm)
    return (
        tf.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(df_count))
        .select("doc_id", "tf", "dl", score.alias("score"))
    )


def phrase_search(postings: DataFrame, doc_stats: DataFrame, query: str, limit: int = 20,
                  phrase: list[str] | None = None) -> DataFrame:
    """Best ``limit`` documents for the phrase, score desc then id."""
    toks = phrase if phrase is not None else query_tokens(query)
    from treeline.session import materialize

    # read twice (hits and their number): written once, it is small
    scored = bm25(materialize(phrase_tf(postings, toks)), corpus_stats(doc_stats))
    return scored.orderBy(F.desc("score"), F.asc("doc_id")).limit(limit)


def rank_scores(hits: DataFrame, order: list[Column], denominator: str = "returned",
                limit: int | None = None) -> DataFrame:
    """Positional score ``1 - i/n`` over an already limited hit list.

    ``denominator='returned'`` uses the number of hits (API form);
    ``'limit'`` uses the requested limit (command-line form).  The global
    window is safe only because ``hits`` holds at most a few hundred rows.
    """
    w = Window.orderBy(*order)
    i = F.row_number().over(w) - 1
    if denominator == "limit":
        n = F.lit(max(limit or 1, 1))
    else:
        n = F.greatest(F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))), F.lit(1))
    return hits.withColumn("rank", i.cast("int")).withColumn("rank_score", F.lit(1.0) - i / n)


def content_hash(fields=("text",)) -> Column:
    """MD5 of the indexed fields."""
    return F.md5(F.concat_ws("\u0000", *[F.coalesce(F.col(f), F.lit("")) for f in fields]))


def needs_index(docs: DataFrame, state: DataFrame, id_col: str = "doc_id", fields=("text",)) -> DataFrame:
    """Documents whose indexed content hash is missing or differs.

    ``state(doc_id, content_hash)`` is written by the indexer.  Comparing
    content hashes (instead of timestamps) means a save that does not
    change the text never triggers a re-index.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), content_hash(fields).alias("content_hash"))
    j = d.join(state.select("doc_id", F.col("content_hash").alias("indexed_hash")), "doc_id", "left")
    return j.select("doc_id", "content_hash",
                    (F.col("indexed_hash").isNull() | (F.col("indexed_hash") != F.col("content_hash"))).alias("needs_index"))


def fold_and_stem(token: str) -> str:
    """Accent folding (NFD, combining marks dropped) then Porter stemming."""
    import unicodedata

    from treeline.functions.porter import stem

    folded = "".join(c for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c))
    return stem(folded)


def stem_vocabulary(postings: DataFrame) -> DataFrame:
    """(token, stem) for the distinct tokens of the postings.

    Stemming runs in a pandas UDF over the vocabulary only -- each distinct
    word once -- never per posting."""
    from treeline.functions.udfs import stem_udf

    return postings.select("token").distinct().withColumn("stem", stem_udf()(F.col("token")))


def stemmed_phrase_search(docs: DataFrame, query: str, limit: int = 20, id_col: str = "doc_id",
                          fields=("text",)) -> DataFrame:
    """X2 with the stemming tokenizer (case fold, accent fold, Porter)."""
    from treeline.session import materialize

    q = [fold_and_stem(t) for t in query_tokens(query)]
    postings = materialize(build_postings(docs, id_col, fields))
    # written first: the stemmer runs once for each distinct word, and the surface forms of the query's stems are few
    vocab = materialize(stem_vocabulary(postings).where(F.col("stem").isin(sorted(set(q)))))
    hits = postings.join(vocab, "token").select("doc_id", "field", "pos", F.col("stem").alias("token"), "dl")
    stats = build_doc_stats(docs, id_col, fields)
    return bm25(materialize(phrase_tf(hits, q)), corpus_stats(stats)).orderBy(F.desc("score"), F.asc("doc_id")).limit(limit)
