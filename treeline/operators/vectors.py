"""Vectors: embedding (X3), upsert (X4), exact and LSH nearest neighbours
(X5, X7) and collection sizes (A14).

Vectors are rows ``(id, embedding array<float>, ...)``.  Distance is the
squared Euclidean distance by default (the behaviour of an L2 collection
created without an explicit metric); similarity = 1 / (1 + distance).

Exact search is one path whatever the batch: the query batch, whose size is
checked, goes to the tasks; the vector table streams past it as Arrow
batches, each task keeps its k best rows of every query, and only those meet
in the final top-k.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Most queries of one search; a larger batch is refused, knn_blocks splits it.
MAX_QUERIES = 16_384
# Characters of the texts that one task turns into hashed features.
TASK_CHARS = 2_000_000
# Distances of one block of rows and queries that a task holds at once.
BLOCK = 2_000_000


def _as_double_array(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def distance(v: Column, q: Column, metric: str = "l2") -> Column:
    """Distance between two numeric arrays of equal length, in double."""
    v = _as_double_array(v)
    q = _as_double_array(q)
    if metric == "l2":
        sq = F.zip_with(v, q, lambda x, y: (x - y) * (x - y))
        return F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x)
    dot = F.aggregate(F.zip_with(v, q, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    if metric == "ip":
        return F.lit(1.0) - dot
    if metric == "cosine":
        nv = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        nq = F.sqrt(F.aggregate(q, F.lit(0.0), lambda a, x: a + x * x))
        return F.lit(1.0) - dot / (nv * nq)
    raise ValueError(f"unknown metric {metric}")


def similarity(dist: Column) -> Column:
    """similarity from distance."""
    return F.lit(1.0) / (F.lit(1.0) + dist)


def _distances(vecs, q, metric: str):
    """Distances of all rows of ``vecs`` to ``q``, in double."""
    import numpy as np

    if metric == "l2":
        return ((vecs - q) ** 2).sum(axis=1)
    dot = vecs @ q
    if metric == "ip":
        return 1.0 - dot
    if metric == "cosine":
        return 1.0 - dot / (np.sqrt((vecs * vecs).sum(axis=1)) * np.sqrt((q * q).sum()))
    raise ValueError(f"unknown metric {metric}")


def _matrix(column):
    """An Arrow list column without nulls as a matrix in double; entries that are null are NaN."""
    import numpy as np

    sizes = column.value_lengths().to_numpy()
    if len(sizes) and sizes[0] and (sizes == sizes[0]).all():
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1)
    return np.array(column.to_pylist(), np.float64)


def _task_topk(queries, k: int, metric: str, id_type, bucketed: bool = False):
    """mapInArrow body: the k nearest rows of every query among a task's
    rows (smaller distance, then smaller id), merged batch by batch.

    Squared distances are screened a block at a time by one matrix product;
    what the product's rounding leaves in doubt is computed again.
    ``bucketed``: only pairs that share a bucket in some hash table count,
    and a block is one bucket of one table."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        best: dict = {}
        qids, Q, times, buckets = queries.value
        limit = 1e290
        sound = np.array([metric == "l2" and q.ndim == 1 and np.abs(q).max(initial=0.0) < 1e140 for q in Q], bool)  # NaN: not sound
        matrices: dict = {}
        for b in batches:
            keep = b["v"].is_valid() if bucketed else pc.and_(b["v"].is_valid(), b["id"].is_valid())
            b = b.filter(keep)
            if not b.num_rows:
                continue
            ids = b["id"].to_pylist()
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i]))
            ids = [ids[i] for i in order]
            vecs = _matrix(b["v"])[order]

            def merge(j, rows):
                d = _distances(vecs[rows], Q[j], metric)
                near = np.arange(len(d)) if len(d) <= k else np.nonzero(d <= np.partition(d, k - 1)[k - 1])[0]
                near = near[np.argsort(d[near], kind="stable")[:k]]  # rows are in the order of their ids
                best[j] = sorted([*best.get(j, ()), *((float(d[i]), ids[rows[i]]) for i in near)], key=lambda x: (x[0], x[1] is not None, x[1]))[:k]

            def screen(rows, js, met=None):
                some, product = vecs[rows], matrices[dim]
                step = max(1, BLOCK // len(rows))
                for at in range(0, len(js), step):
                    part = js[at:at + step]
                    s = norms[rows][None, :] + qnorms[part][:, None] - 2.0 * (product[part] @ some.T)
                    if met is not None:
                        s[met(rows, part)] = np.inf
                    bound = np.array([best[j][-1][0] if len(best.get(j, ())) == k else np.inf for j in part])
                    fresh = np.nonzero(~np.isfinite(bound))[0]
                    if len(fresh) and len(rows) > k:
                        bound[fresh] = np.partition(s[fresh], k - 1, axis=1)[:, k - 1]
                    doubt = 2e-14 * (dim + 8) * (norms[rows].max() + qnorms[part])
                    near = np.isfinite(s) & (s <= (bound + doubt)[:, None])
                    for i in np.nonzero(near.any(axis=1))[0]:
                        merge(part[i], rows[np.nonzero(near[i])[0]])

            dim = vecs.shape[1]
            norms = (vecs * vecs).sum(axis=1)
            plain = np.nonzero(norms < limit)[0]
            if dim not in matrices:
                fits = sound & np.array([q.shape == (dim,) for q in Q], bool)
                matrices[dim] = np.array([q if f else np.zeros(dim) for q, f in zip(Q, fits)]).reshape(len(Q), dim)
                matrices[dim, "fits"] = fits
            qnorms, fits = (matrices[dim] ** 2).sum(axis=1), matrices[dim, "fits"]
            if bucketed:
                h = np.array(b["h"].to_pylist(), np.float64).reshape(len(ids), -1)[order]
                for t in range(h.shape[1]):
                    def met(rows, js, t=t):
                        return (h[rows][None, :, :t] == buckets[js][:, None, :t]).any(axis=2)
                    for value in np.unique(h[plain, t]):
                        js = np.nonzero(fits & (buckets[:, t] == value))[0]
                        if len(js):
                            screen(plain[h[plain, t] == value], js, met if t else None)
                continue
            huge = bool((np.isfinite(vecs).all(axis=1) & ~(norms < limit)).any())
            quick = fits if len(plain) >= k and not huge else np.zeros(len(Q), bool)
            if quick.any():
                screen(plain, np.nonzero(quick)[0])
            for j in np.nonzero(~quick)[0]:
                merge(j, np.arange(len(ids)))
        rows = [(qids[j], x, d) for j, top in best.items() for d, x in [r for r in top for _ in range(times[j])][:k]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], id_type[0]), pa.array([r[1] for r in rows], id_type[1]), pa.array([r[2] for r in rows], pa.float64())],
            ["query_id", "id", "distance"])

    return run


def _nearest(v: DataFrame, q: DataFrame, k: int, metric: str, bucketed: bool = False) -> DataFrame:
    """Rows ``v(id, v[, h])`` against one batch ``q(query_id, query_vec, times[, h])``."""
    import numpy as np
    from pyspark.sql.pandas.types import to_arrow_type

    rows = q.limit(MAX_QUERIES + 1).collect()
    if len(rows) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries in one batch")
    types = [q.schema["query_id"].dataType, v.schema["id"].dataType]
    buckets = np.array([r[3] for r in rows], np.float64) if bucketed and rows else None
    sent = v.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [np.array(r[1], np.float64) for r in rows], [r[2] for r in rows], buckets))
    schema = f"query_id {types[0].simpleString()}, id {types[1].simpleString()}, distance double"
    part = v.mapInArrow(_task_topk(sent, k, metric, [to_arrow_type(t) for t in types], bucketed and bool(rows)), schema)
    w = Window.partitionBy("query_id").orderBy(F.asc("distance"), F.asc("id"))
    ranked = part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.withColumn("score", similarity(F.col("distance")))


def _in_blocks(q: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``search`` over hashed blocks of at most MAX_QUERIES of the different
    queries ``q(query_id, query_vec, ...)``.  Passes are written one by one,
    so the driver holds one block at a time."""
    from treeline.session import materialize

    n = q.count()
    if n <= MAX_QUERIES:
        return search(q)
    blocks = -(-2 * n // MAX_QUERIES)
    while True:
        dealt = q.withColumn("_block", F.pmod(F.xxhash64("query_id", "query_vec"), F.lit(blocks)))
        used = {r[0]: r[1] for r in dealt.groupBy("_block").count().collect()}
        if max(used.values()) <= MAX_QUERIES:
            break
        blocks *= 2
    dealt = materialize(dealt, "stage")
    out = None
    for b in sorted(used):
        part = materialize(search(dealt.where(F.col("_block") == b).drop("_block")), "stage")
        out = part if out is None else out.unionByName(part)
    return out


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding",
        qid_col: str = "query_id", qvec_col: str = "query_vec", metric: str = "l2") -> DataFrame:
    """X5 exact: for every query the ``k`` nearest vectors.

    Returns ``(query_id, id, distance, score, rank)``; ties broken by id.
    Ids may be of any ordered type.  An empty query batch gives an empty
    result; one of more than MAX_QUERIES is refused, see :func:`knn_blocks`.
    Null ids and vectors are no neighbours.
    """
    q = queries.select(F.col(qid_col).alias("query_id"), F.col(qvec_col).alias("query_vec"), F.lit(1).alias("times"))
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    return _nearest(v, q, k, metric)


def knn_blocks(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding",
               qid_col: str = "query_id", qvec_col: str = "query_vec", metric: str = "l2") -> DataFrame:
    """X5 exact for any number of queries (repeated rows are one): :func:`knn`
    over hashed blocks of at most MAX_QUERIES, one pass each."""
    q = queries.select(F.col(qid_col).alias("query_id"), F.col(qvec_col).alias("query_vec")).distinct()
    return _in_blocks(q, lambda some: knn(vectors, some, k, id_col, vec_col, metric=metric))


def hash_features(df: DataFrame, id_cols: list[str], text_col: str, dim: int = 384) -> DataFrame:
    """X3 offline encoder as rows ``id_cols, bucket, weight``: term
    frequencies of tokens hashed by the first 16 bits of their MD5, scaled
    to length 1.  A text without tokens has no rows."""
    from treeline.operators.text_index import tokens

    t = df.select(*id_cols, F.explode(tokens(F.col(text_col))).alias("token"))
    # each distinct token of a text is hashed once
    per = t.groupBy(*id_cols, "token").agg(F.count(F.lit(1)).alias("n"))
    bucket = F.conv(F.substring(F.md5("token"), 1, 4), 16, 10).cast("int") % dim
    tf = per.groupBy(*id_cols, bucket.alias("bucket")).agg(F.sum("n").alias("tf"))
    norm = tf.groupBy(*id_cols).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    return tf.join(norm, id_cols).select(*id_cols, "bucket", (F.col("tf") / F.col("norm")).alias("weight"))


def embed_hashed(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = 384,
                 id_cols: list[str] | None = None) -> DataFrame:
    """X3 offline default encoder: :func:`hash_features` as an array column.
    ``id_cols`` name a row (default: the first column); a text without
    tokens has a vector of zeros."""
    from treeline.session import materialize

    ids = id_cols or df.columns[:1]
    # a text becomes many token rows within its task, so tasks are cut by the texts' length, not by the bytes they arrive in
    df = materialize(df, "stage")
    chars = df.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]
    cores = df.sparkSession.sparkContext.defaultParallelism
    df = df.repartition(max(1, -(-chars // TASK_CHARS), min(cores, chars // 500_000)), *ids)
    rows = hash_features(df, ids, text_col, dim).groupBy(*ids).agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("_m"))  # at most dim entries
    at = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)).cast("float"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return df.join(rows, ids, "left").withColumn(out_col, F.when(F.col("_m").isNull(), zero).otherwise(at)).drop("_m")


def embed_with(df: DataFrame, text_col: str, encoder_factory: Callable[[], Callable], out_col: str = "embedding") -> DataFrame:
    """X3 pluggable encoder (D1): ``encoder_factory()`` is called once per
    Python worker; its result maps a list of texts to a list of vectors.
    Batches arrive through Arrow."""
    from treeline.functions.udfs import encoder_udf

    return df.withColumn(out_col, encoder_udf(encoder_factory)(F.col(text_col)))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Replace the rows of ``existing`` whose key appears in ``incoming``."""
    kept = existing.join(incoming.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))


def collection_sizes(vectors: DataFrame, kind_col: str = "kind") -> DataFrame:
    """Rows per collection."""
    return vectors.groupBy(kind_col).agg(F.count(F.lit(1)).alias("n_vectors"))


def lsh_candidates(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding",
                   qid_col: str = "query_id", qvec_col: str = "query_vec", bucket_length: float = 2.0,
                   num_tables: int = 4, seed: int = 7) -> DataFrame:
    """X5 approximate: bucketed random projection LSH candidates, re-ranked
    exactly.  Candidates are the pairs that share a bucket in some table.
    A query batch goes to the tasks with its buckets; a task compares the
    rows of a bucket with the queries of that bucket only, so the cost
    follows the bucket sizes and no pair is shuffled or listed.  A repeated
    query meets every candidate as often."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), array_to_vector(_as_double_array(F.col(vec_col))).alias("features"))
    q = queries.select(F.col(qid_col).alias("query_id"), F.col(qvec_col).alias("query_vec"), array_to_vector(_as_double_array(F.col(qvec_col))).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket_length,
                                        numHashTables=num_tables, seed=seed).fit(v)
    h = F.array(*[F.get(vector_to_array(F.get("hashes", F.lit(t))), F.lit(0)) for t in range(num_tables)]).alias("h")
    hv = model.transform(v).select("id", "v", h)
    hq = model.transform(q).select("query_id", "query_vec", h).groupBy("query_id", "query_vec", "h").agg(F.count("*").alias("times"))
    return _in_blocks(hq.select("query_id", "query_vec", "times", "h"), lambda some: _nearest(hv, some, k, "l2", bucketed=True))


def project_vector_rows(projects: DataFrame) -> DataFrame:
    """F9 / X4 input: the text embedded for each project and its metadata.

    ``projects(id, name, short_description, long_description, keywords
    array<string>, readme_content)``.  Text = name, short and long
    description, 'Keywords: a, b', first 1000 README characters, joined by
    '. ' with empty parts skipped; metadata keeps 500 characters of the
    short description and the first 20 keywords; the stored document is the
    first 5000 characters of the text.
    """
    from treeline.functions import fixed

    def nz(c):
        return F.when(F.coalesce(c, F.lit("")) != "", c)

    kw = F.coalesce(F.col("keywords"), F.array().cast("array<string>"))
    text = F.concat_ws(
        ". ", F.col("name"), nz(F.col("short_description")), nz(F.col("long_description")),
        F.when(F.size(kw) > 0, F.concat(F.lit("Keywords: "), F.array_join(kw, ", "))),
        nz(F.substring(F.col("readme_content"), 1, fixed.README_EXCERPT_CHARS)))
    return projects.select(
        F.col("id").cast("long").alias("id"), F.lit("project").alias("kind"), F.col("id").cast("long").alias("project_id"),
        text.alias("text"),
        F.col("name").alias("meta_name"),
        F.coalesce(F.substring("short_description", 1, fixed.SHORT_DESCRIPTION_CHARS), F.lit("")).alias("meta_short_description"),
        F.array_join(F.slice(kw, 1, fixed.VECTOR_KEYWORDS), ",").alias("meta_keywords"),
        F.substring(text, 1, fixed.PROJECT_DOCUMENT_CHARS).alias("document"),
    )


def module_vector_rows(modules: DataFrame, projects: DataFrame) -> DataFrame:
    """F9 / X4 input for modules: '<project>: <name> - <description>'; the
    document keeps 2000 characters of the description.  Ids are real
    columns (module id, project id), not a packed string."""
    from treeline.functions import fixed

    p = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    m = modules.join(p, "project_id")
    desc = F.coalesce(F.col("description"), F.lit(""))
    text = F.concat(F.col("project_name"), F.lit(": "), F.col("name"), F.lit(" - "), desc)
    return m.select(
        F.col("module_id").cast("long").alias("id"), F.lit("module").alias("kind"), F.col("project_id").cast("long"),
        text.alias("text"), F.col("name").alias("meta_name"), F.col("project_name").alias("meta_project_name"),
        F.col("path").alias("meta_path"), F.substring(desc, 1, fixed.MODULE_DOCUMENT_CHARS).alias("document"),
    )


def filter_vectors(vecs: DataFrame, keyword: str | None = None, project_id=None) -> DataFrame:
    """Metadata filters applied before any distance is computed."""
    out = vecs
    if keyword:
        out = out.where(F.array_contains(F.split(F.coalesce(F.col("meta_keywords"), F.lit("")), ","), keyword))
    if project_id is not None:
        out = out.where(F.col("project_id") == project_id)
    return out


def search_modules(vecs: DataFrame, query: DataFrame, k: int, projects: DataFrame, project: str | None = None) -> DataFrame:
    """Module search in the project of that name (``projects``:
    project_id, name); a name that no project has, like none, filters nothing."""
    m = vecs.where(F.col("kind") == "module")
    if project:
        ids = [r.project_id for r in projects.where(F.col("name") == project).select("project_id").distinct().limit(1).collect()]
        m = filter_vectors(m, project_id=ids[0]) if ids else m
    return knn(m, query, k)


def refresh_vectors(existing: DataFrame | None, rows: DataFrame, dim: int = 384,
                    encoder_factory: Callable[[], Callable] | None = None) -> DataFrame:
    """Embed the given rows (hashed features by default, or a pluggable
    encoder) and replace their (kind, id) entries in the vector table."""
    emb = embed_with(rows, "text", encoder_factory) if encoder_factory else embed_hashed(rows, "text", dim=dim, id_cols=["kind", "id"])
    if existing is None:
        return emb
    for c in emb.columns:
        if c not in existing.columns:
            existing = existing.withColumn(c, F.lit(None).cast(emb.schema[c].dataType))
    return upsert(existing.select(*emb.columns), emb, ["kind", "id"])
