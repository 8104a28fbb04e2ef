"""Search: phrase BM25, kNN, hybrid and its degraded forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.operators import search, text_index, vectors


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _brute_bm25(texts, phrase, k1=1.2, b=0.75):
    import regex

    toks = [[t for t in regex.split(r"[^\p{L}\p{N}]+", x.lower()) if t] for x in texts]
    n = len(phrase)
    tf = [sum(1 for i in range(len(t) - n + 1) if t[i:i + n] == phrase) for t in toks]
    N = len(texts)
    avgdl = sum(len(t) for t in toks) / N
    df = sum(1 for x in tf if x)
    idf = math.log((N - df + 0.5) / (df + 0.5))
    idf = 1e-6 if idf <= 0 else idf
    return {i: idf * f * (k1 + 1) / (f + k1 * (1 - b + b * len(toks[i]) / avgdl)) for i, f in enumerate(tf) if f}


def test_hybrid_keeps_fts_without_vectors(spark):
    hits = spark.createDataFrame([(1, 5.0)], "id long, score double")
    r = search.hybrid(hits, None, limit=5).collect()
    assert [(x.id, round(x.score, 6)) for x in r] == [(1, 0.3)]


def test_semantic_unavailable_is_empty(spark):
    empty = spark.createDataFrame([], "id long, score double")
    catalog = spark.createDataFrame([(1,)], "id long")
    assert search.resolve_semantic(empty, catalog).count() == 0


def test_semantic_hits_on_dead_ids_dropped(spark):
    sem = spark.createDataFrame([(1, 0.9), (2, 0.8)], "id long, score double")
    catalog = spark.createDataFrame([(2,)], "id long")
    assert [r.id for r in search.resolve_semantic(sem, catalog).collect()] == [2]


def test_rank_scores_returned_vs_limit(spark):
    hits = spark.createDataFrame([(i, 10.0 - i) for i in range(4)], "id long, score double")
    api = {r.id: r.rank_score for r in text_index.rank_scores(hits, [F.desc("score"), F.asc("id")]).collect()}
    assert api == {0: 1.0, 1: 0.75, 2: 0.5, 3: 0.25}
    cli = {r.id: r.rank_score for r in text_index.rank_scores(hits, [F.desc("score")], "limit", 10).collect()}
    assert cli[3] == pytest.approx(0.7)


TEXTS = [
    "The on the on, THE ON!", "nothing here", "the  on", "theon the-on", "", "on the on the",
    "Über die Brücke, the on", "a a a a", "the\non\tthe on",
]


@pytest.mark.parametrize("phrase", [["the", "on"], ["a", "a"], ["on"], ["the", "on", "the"]])
def test_phrase_scan_and_postings_equal_brute_force(spark, phrase):
    docs = _docs(spark, TEXTS)
    want = _brute_bm25(TEXTS, phrase)
    scan = {r.doc_id: r.score for r in text_index.phrase_search_scan(docs, "", 100, phrase=phrase).collect()}
    post = {r.doc_id: r.score for r in text_index.phrase_search(
        text_index.build_postings(docs), text_index.build_doc_stats(docs), "", 100, phrase=phrase).collect()}
    assert scan.keys() == want.keys() == post.keys()
    for k in want:
        assert scan[k] == pytest.approx(want[k]) and post[k] == pytest.approx(want[k])


def test_phrase_counts_random_texts(spark):
    rnd = random.Random(7)
    words = ["the", "on", "The", "ON", "x", "théon", "9"]
    seps = [" ", "  ", ", ", "\n", "-", ""]
    texts = ["".join(rnd.choice(words) + rnd.choice(seps) for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    docs = _docs(spark, texts)
    got = {r.doc_id: r.tf for r in text_index.phrase_counts(docs, ["the", "on"]).collect()}
    tf = text_index.phrase_tf(text_index.build_postings(docs), ["the", "on"])
    by_post = {r.doc_id: r.tf for r in tf.collect()}
    for i in range(len(texts)):
        assert got[i] == by_post.get(i, 0)


def test_knn_matches_numpy(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(50, 8)).astype("float32")
    vecs = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(50)], "id long, embedding array<float>")
    q = spark.createDataFrame([(100, [float(x) for x in v[3]]), (101, [float(x) for x in v[7]])],
                              "query_id long, query_vec array<float>")
    got = vectors.knn(vecs, q, 5).collect()
    for qid, src in ((100, 3), (101, 7)):
        d = ((v.astype("float64") - v[src].astype("float64")) ** 2).sum(axis=1)
        want = sorted(range(50), key=lambda i: (d[i], i))[:5]
        mine = [r.id for r in sorted((r for r in got if r.query_id == qid), key=lambda r: r.rank)]
        assert mine == want
    top = [r for r in got if r.query_id == 100 and r.rank == 1][0]
    assert top.score == pytest.approx(1.0)


def test_knn_batches_and_odd_ids(spark, monkeypatch):
    vecs = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "id long, embedding array<float>")
    q = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(7)], "query_id long, query_vec array<float>")
    got = vectors.knn(vecs, q, 1).collect()
    assert sorted((r.query_id, r.id) for r in got) == [(i, i) for i in range(7)]
    assert vectors.knn(vecs, q.limit(0), 1).count() == 0 and vectors.knn(vecs.limit(0), q, 1).count() == 0
    named = q.selectExpr("concat('q', query_id) as query_id", "query_vec")
    assert sorted((r.query_id, r.id) for r in vectors.knn(vecs, named, 1).collect()) == [(f"q{i}", i) for i in range(7)]
    monkeypatch.setattr(vectors, "MAX_QUERIES", 3)
    with pytest.raises(ValueError):
        vectors.knn(vecs, q, 1)


def test_stemmed_phrase_search(spark):
    docs = _docs(spark, ["Running dogs run", "the runner", "run dog", "ran DOGS", "running, dog!"])
    got = {r.doc_id: r.tf for r in text_index.stemmed_phrase_search(docs, "run dogs", 10).collect()}
    assert got == {0: 1, 2: 1, 4: 1}
    assert text_index.fold_and_stem("Éléments".lower()) == "element"


def test_pluggable_encoder(spark):
    def factory():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")
    got = {r.id: r.embedding for r in vectors.embed_with(df, "text", factory).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 1.0]}


def test_vector_rows_text_and_refresh(spark):
    projects = spark.createDataFrame(
        [(1, "proj", "short", "", ["a", "b"], "readme"), (2, "other", None, None, [], None)],
        "id long, name string, short_description string, long_description string, keywords array<string>, "
        "readme_content string")
    rows = {r.id: r for r in vectors.project_vector_rows(projects).collect()}
    assert rows[1].text == "proj. short. Keywords: a, b. readme" and rows[1].meta_keywords == "a,b"
    assert rows[2].text == "other" and rows[2].meta_short_description == ""
    mods = spark.createDataFrame([(10, 1, "m", "p/m.py", "does x")],
                                 "module_id long, project_id long, name string, path string, description string")
    mrow = vectors.module_vector_rows(mods, projects).collect()[0]
    assert mrow.text == "proj: m - does x" and mrow.id == 10
    v1 = vectors.refresh_vectors(None, vectors.project_vector_rows(projects), dim=16)
    v2 = vectors.refresh_vectors(v1, vectors.project_vector_rows(projects.where("id = 1")), dim=16)
    assert v2.count() == 2
    assert [r.id for r in vectors.filter_vectors(v2, keyword="a").collect()] == [1]


def test_knn_equals_sql_distances(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 16)).astype("float32")
    v[10] = v[11]      # exact tie
    vecs = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(300)], "id long, embedding array<float>")
    q = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(0, 300, 3)], "query_id long, query_vec array<float>")
    for metric in ("l2", "ip", "cosine"):
        got = sorted((r.query_id, r.rank, r.id, round(r.distance, 6)) for r in vectors.knn(vecs.repartition(5), q, 4, metric=metric).collect())
        sql = vecs.crossJoin(q.withColumnRenamed("query_id", "qid")).select(
            "qid", "id", vectors.distance(F.col("embedding"), F.col("query_vec"), metric).alias("d")).collect()
        want = []
        for i in range(0, 300, 3):
            top = sorted((round(r.d, 9), r.id) for r in sql if r.qid == i)[:4]
            want += [(i, k + 1, x, round(d, 6)) for k, (d, x) in enumerate(top)]
        assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]


def test_attach_keeps_known_hits(spark):
    hits = spark.createDataFrame([(2, 1, 0.9), (7, 2, 0.5)], "id long, rank int, score double")
    projects = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert [(r.id, r.name, r.rank) for r in search.attach(hits, projects).collect()] == [(2, "b", 1)]


def test_module_search_unknown_project_means_no_filter(spark):
    names = spark.createDataFrame([(1, "one"), (2, "two")], "project_id long, name string")
    vecs = spark.createDataFrame([(1, [0.0, 0.0], 1, "module"), (2, [1.0, 0.0], 2, "module"), (3, [0.0, 0.1], 1, "project")],
                                 "id long, embedding array<float>, project_id long, kind string")
    q = spark.createDataFrame([(0, [0.0, 0.0])], "query_id long, query_vec array<float>")
    assert [r.id for r in vectors.search_modules(vecs, q, 5, names, "nobody").orderBy("rank").collect()] == [1, 2]
    assert [r.id for r in vectors.search_modules(vecs, q, 5, names, "two").collect()] == [2]


def test_lsh_recall_over_query_blocks_against_brute_force(spark, monkeypatch):
    from treeline.plans.vector_queries import x5_lsh_recall

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    queries = [i for i in ids if i % 20 == 0]
    monkeypatch.setattr(vectors, "MAX_QUERIES", 8)
    assert len(queries) > 8
    e = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id as id", "embedding")
    q = e.where("id % 20 = 0").selectExpr("id as query_id", "embedding as query_vec")
    exact, approx = ({} for _ in range(2))
    for out, df in ((exact, vectors.knn_blocks(e, q.union(q.limit(3)), 10)), (approx, vectors.lsh_candidates(e, q, 10))):
        for r in df.collect():
            out.setdefault(r.query_id, []).append(r.id)
    want = {}
    for i in queries:
        d = ((v - v[ids.index(i)]) ** 2).sum(axis=1)
        want[i] = {ids[j] for j in sorted(range(len(ids)), key=lambda j: (d[j], ids[j]))[:10]}
    assert {i: set(x) for i, x in exact.items()} == want and all(len(x) == 10 for x in exact.values())
    recall = {i: len(want[i] & set(approx.get(i, ()))) / 10 for i in queries}
    assert sum(recall.values()) >= 0.9 * len(queries)
    assert {r.query_id: round(r.recall, 6) for r in x5_lsh_recall(spark, sf).collect()} == recall


def test_lsh_lists_no_pairs_and_equals_brute_force(spark, monkeypatch):
    """Vectors of length 1 fill a handful of buckets, so joined pairs would be nearly all vectors x queries."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[40:60] = x[40]  # copies: ties go to the smaller id
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(7, [float(a) for a in x[7]])]
    e = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    q = e.where("id % 20 = 0").selectExpr("id as query_id", "embedding as query_vec")
    q = q.unionByName(q.where("query_id = 40"))
    monkeypatch.setattr(vectors, "BLOCK", 500)
    out = vectors.lsh_candidates(e, q, 10, bucket_length=1.5, num_tables=2)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()

    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    f = e.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=1.5, numHashTables=2, seed=7).fit(f)
    h = {r.id: [v[0] for v in r.hashes] for r in model.transform(f).collect()}
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.distance))
    assert any(a != b for a in h.values() for b in h.values())
    for i in range(0, 300, 20):
        near = [(float(((x[j].astype(float) - x[i]) ** 2).sum()), j) for j, _ in rows if any(a == b for a, b in zip(h[i], h[j]))]
        near = sorted(near * (2 if i == 40 else 1))[:10]
        assert [(j, pytest.approx(d)) for d, j in near] == [(j, d) for _, j, d in sorted(got[i])]


def test_embedding_tasks_are_cut_by_the_length_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TASK_CHARS", 200)
    df = spark.createDataFrame([(i, "k", "a b c d " * 5 if i % 9 else None) for i in range(100)], "id long, kind string, text string").coalesce(1)
    out = vectors.embed_hashed(df, "text", dim=8, id_cols=["kind", "id"])
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 8
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == 100 and sum(rows[9].embedding) == 0 and rows[1].embedding == rows[2].embedding
    assert sum(x * x for x in rows[1].embedding) == pytest.approx(1)
