import hashlib
import random

import numpy as np

from treeline.llm import op7_fingerprints as op

SMOKE = "/root/testdata/sf0.001"


def jaccard(a, b):
    def s(t):
        w = (t or "").split()
        n = min(5, len(w))
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
    x, y = s(a), s(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def check(rows, docs):
    """docs: (doc_id, text) in order."""
    of = op.Fingerprinter()
    want = {}
    for k, (d, t) in enumerate(docs):
        t, n = t or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(t) // 2
        e = t[:len(t) - half] + n[:half]
        want.setdefault(d, []).append((len(t), hashlib.sha256(e.encode()).hexdigest(), op.packed(of(t)), op.packed(of(e)), jaccard(t, e), jaccard(t, n)))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert got.keys() == want.keys()
    errors = []
    for d in want:
        a, b = sorted(got[d], key=str), sorted(want[d], key=str)
        assert [x[:4] for x in a] == [x[:4] for x in b]
        errors += [abs(x[4] - y[4]) for x, y in zip(a, b)] + [abs(x[5] - y[5]) for x, y in zip(a, b)]
    return np.array(errors)


def test_query(llm):
    from treeline.llm.registry import QUERIES

    docs = sorted((r.doc_id, r.text) for r in llm.read.parquet(f"{SMOKE}/documents.parquet").collect())
    errors = check(QUERIES["op7_fingerprints"](llm, SMOKE).collect(), docs)
    assert np.sqrt((errors ** 2).mean()) < 0.05 and errors.max() < 0.2


def run(df):
    return op.with_followers(df.select("doc_id", "text"), op._compared, op._SCHEMA, op._ARROW).collect()


def test_odd_rows(llm, fixture_docs):
    docs = sorted(((r.doc_id, r.text) for r in fixture_docs.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    check(run(fixture_docs), docs)
    assert run(fixture_docs.limit(0)) == []
    one = llm.createDataFrame([(4, "a b c d e f")], "doc_id long, text string")
    check(run(one), [(4, "a b c d e f")])


def test_many_ranges(llm):
    rng = random.Random(3)
    docs = [(i * i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60)))) for i in range(300)]
    shuffled = rng.sample(docs, len(docs))
    check(run(llm.createDataFrame(shuffled, "doc_id long, text string").repartition(7)), docs)


def test_likeness_is_unbiased():
    rng = random.Random(4)
    of = op.Fingerprinter()
    for n in (8, 60, 2000):
        diff = []
        for _ in range(40):
            w = [str(rng.random()) for _ in range(n)]
            v = w[:n // 2] + [str(rng.random()) for _ in range(n - n // 2)]
            a, b = " ".join(w), " ".join(v)
            diff.append(op.likeness(of(a), of(b)) - jaccard(a, b))
        assert abs(np.mean(diff)) < 0.03
