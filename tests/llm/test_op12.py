import zlib

import numpy as np
from pyspark.sql import functions as F

from treeline.llm import op12_quality as op

DATA = "/root/testdata/sf0.1"


def test_fit_and_scores_against_brute_force(llm):
    docs = llm.read.parquet(f"{DATA}/documents.parquet").limit(600)
    labels = llm.read.parquet(f"{DATA}/labels.parquet")
    rows = docs.select("doc_id", "text").collect()
    label = {}
    for r in labels.collect():
        if r.quality is not None:
            label[r.doc_id] = min(r.quality, label.get(r.doc_id, 1))
    x = np.array([op.statistics(r.text) for r in rows])
    y = np.array([label.get(r.doc_id, -1) for r in rows])
    got = {r.doc_id: r.score for r in op.quality(docs, labels).collect()}
    # the same model, written out: pooled scale, covariances blended and shrunk, log densities by inverses
    groups = [x[y == k] for k in (0, 1)]
    n, p = sum(map(len, groups)), x.shape[1]
    within = sum(((g - g.mean(0)).T @ (g - g.mean(0))) for g in groups) / n
    sd, mid = np.sqrt(np.diag(within)), np.concatenate(groups).mean(0)
    z, dens = (x - mid) / sd, []
    for g in groups:
        u = (g - mid) / sd
        s = (np.cov(u.T, bias=True) * len(g) + p * within / np.outer(sd, sd)) / (len(g) + p)
        t, t2 = np.trace(s), np.trace(s @ s)
        r = min(1, ((1 - 2 / p) * t2 + t * t) / ((len(g) + 1 - 2 / p) * (t2 - t * t / p)))
        c = (1 - r) * s + (r * t / p + 1e-6) * np.eye(p)
        d = z - u.mean(0)
        dens.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1] + np.log((len(g) + .5) / (n + 1)))
    want = 1 / (1 + np.exp(-np.clip((dens[1] - dens[0]) / p, -36, 36)))
    assert min(map(len, groups)) > 20
    assert np.allclose([got[r.doc_id] for r in rows], want, rtol=1e-6, atol=1e-9)


def test_held_out_accuracy(llm):
    from treeline.llm.registry import QUERIES

    rows = QUERIES["op12_quality"](llm, DATA)
    labels = llm.read.parquet(f"{DATA}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    got = rows.join(labels, "doc_id").collect()
    assert rows.count() == llm.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    for k, least in ((0, 0.97), (1, 0.97)):
        own = [r for r in got if r.held_out and r.quality == k]
        assert len(own) > 100 and sum(r.predicted == k for r in own) >= least * len(own)


def test_held_out_labels_are_not_read(llm):
    docs = llm.read.parquet(f"{DATA}/documents.parquet").limit(300).select("doc_id", "text")
    labels = llm.read.parquet(f"{DATA}/labels.parquet")
    turned = labels.withColumn("quality", F.when(op.fold() == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: round(r.score, 9) for r in op.quality(docs, y, op.fold() != 1).collect()} for y in (labels, turned))
    assert a == b


def test_odd_rows(llm, fixture_docs):
    labels = llm.createDataFrame([(1, 1), (4, 0), (5, 0), (6, 1), (7, 1), (7, 0), (None, 0), (99, 1), (3, None), (10, 2)], "doc_id long, quality int")
    docs = fixture_docs.withColumn("score", F.lit("clash"))
    got = op.quality(docs, labels).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 and np.isfinite(r.score) for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(r.text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert {c for c in got[0].asDict()} == {"doc_id", "text", "n_tokens", "score", "predicted"}


def test_empty_tables_and_one_class(llm):
    none = llm.createDataFrame([], "doc_id long, quality int")
    docs = llm.createDataFrame([(1, "one text"), (2, None)], "doc_id long, text string")
    assert op.quality(docs.limit(0), none).count() == 0
    assert {r.score for r in op.quality(docs, none).collect()} == {0.5}
    one = llm.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in op.quality(docs, one).collect())
