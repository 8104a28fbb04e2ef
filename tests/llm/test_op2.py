import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from treeline.llm import op2_suffix_dedup as op
from treeline.llm.suffix_sort import repeated, sort_suffixes

SMOKE = "/root/testdata/sf0.001"


def brute(texts, size):
    """(n_bytes, spans, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - size + 1):
            if seen[d[i:i + size]] > 1:
                gone[i] += 1
                gone[i + size] -= 1
        flag = np.cumsum(gone[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(int), [0]])))
        out.append((len(d), list(zip(edge[::2].tolist(), edge[1::2].tolist())), bytes(b for b, f in zip(d, flag) if not f)))
    return out


def test_query(llm):
    from treeline.llm.registry import QUERIES

    docs = llm.read.parquet(f"{SMOKE}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op2_suffix_dedup"](llm, SMOKE).collect()}
    want = brute([d.text for d in docs], 400)
    assert sum(bool(w[1]) for w in want) > 3
    for d, (n, spans, kept) in zip(docs, want):
        assert got[d.doc_id] == (n, sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")), d.doc_id


def corpus(seed, n=60):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(20, 160))) for _ in range(6)]
    texts = [None, "", "a" * 300, "ab" * 100, pool[0] * 3, "é" * 90]
    for _ in range(n):
        parts = [rng.choice(pool) if rng.random() < .6 else "".join(rng.choice("abcdé ") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(5))]
        texts.append("".join(p[rng.randrange(8):] for p in parts))
    return texts + texts[10:13]


@pytest.mark.parametrize("most", [1000, 2])
def test_against_brute_force(llm, monkeypatch, most):
    texts = corpus(most)
    monkeypatch.setattr(op, "MOST", most)
    rows = [(i if i % 9 else None, t, "x") for i, t in enumerate(texts)]
    rows += [rows[20], (7, "another text with the id seven", "y")]
    df = llm.createDataFrame(rows, "doc_id long, text string, first string").repartition(5)
    spans = op.repeat_spans(df, 40, 20, most)
    monkeypatch.setattr(op, "repeat_spans", lambda docs, size: spans)
    out = op.without_repeats(df, 40)
    got = sorted(((r.text or "", [(s.start, s.stop) for s in r.kept.spans], bytes(r.kept.data)) for r in out.collect()), key=repr)
    want = brute([r[1] for r in rows], 40)
    assert got == sorted(((r[1] or "", w[1], w[2]) for r, w in zip(rows, want)), key=repr)
    assert out.columns == [*df.columns, "kept"]


def test_empty(llm):
    df = llm.createDataFrame([], "doc_id long, text string")
    assert op.without_repeats(df).count() == 0


def test_sorted_like_python():
    rng = random.Random(6)
    for depth in (64, 80, 120):
        base = [bytes(rng.choice(b"ab") for _ in range(200)) for _ in range(3)]
        data = b"".join(rng.choice(base)[:rng.randrange(90, 200)] for _ in range(30)) + bytes(depth)
        starts = np.array(sorted(rng.sample(range(len(data) - depth), 1500)))
        order, group = sort_suffixes(data, starts, depth)
        keys = [data[s:s + depth] for s in starts[order]]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(starts)))
        first = {}
        for k, x in enumerate(keys):
            first.setdefault(x, k)
        assert group.tolist() == [first[x] for x in keys]
        count = Counter(data[s:s + depth] for s in starts)
        assert repeated(data, starts, depth).tolist() == [count[data[s:s + depth]] > 1 for s in starts]
