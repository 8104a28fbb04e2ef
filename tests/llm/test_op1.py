import random

import numpy as np

from treeline.llm import op1_toxicity as op

SMOKE = "/root/testdata/sf0.1"


def test_held_out_accuracy(llm):
    from treeline.llm.registry import QUERIES

    got = QUERIES["op1_toxicity"](llm, SMOKE)
    j = got.join(llm.read.parquet(f"{SMOKE}/labels.parquet"), "doc_id").join(
        llm.read.parquet(f"{SMOKE}/documents.parquet").selectExpr("doc_id", "lang", "text rlike '(?i)\\\\b(idiot|scum|stupid)\\\\b' as rude"), "doc_id")
    rows = j.where("held_out").collect()
    assert got.count() == 10000
    clean = [r for r in rows if not r.toxic]
    caught = [r for r in rows if r.toxic and r.rude]
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert sum(r.predicted for r in caught) >= 0.95 * len(caught)
    s = np.array([r.score for r in rows])
    assert ((0 <= s) & (s <= 1)).all()


def make(spark, n=200, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        y = int(rng.random() < .3)
        w = [rng.choice(["the", "lorem", "ipsum", "dolor", "and"]) for _ in range(rng.randrange(5, 40))]
        if y:
            w.insert(rng.randrange(len(w)), "vilething")
        docs.append((i, " ".join(w), "extra"))
        labels.append((i, y))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), labels


def test_learns_and_odd_rows(llm):
    docs, labels = make(llm)
    y = llm.createDataFrame([*labels, (5, None), (None, 1), (99999, 1), labels[0], (1, 0)], "doc_id long, toxic int")
    model = op.train(docs, y)
    odd = llm.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "lorem " * 20000 + "vilething", "c"), (4, "lorem dolor", "d"), (4, "lorem dolor", "d"), (None, "漢字", "e")], docs.schema)
    rows = op.score(odd, model, "s").orderBy("score").collect()
    assert [r.s >= .5 for r in rows] == [False, False, True, False, False, False]
    assert rows[0].s == rows[1].s and rows[3].s == rows[4].s
    kept = op.drop_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == 5
    assert op.score(odd.limit(0), model, "s").count() == 0


def test_without_both_classes(llm):
    docs, labels = make(llm, 20)
    none = op.train(docs, llm.createDataFrame([], "doc_id long, toxic int"))
    one = op.train(docs, llm.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int"))
    assert op.score(docs, none, "s").first().s == 0.5
    assert op.score(docs, one, "s").first().s < 0.1
