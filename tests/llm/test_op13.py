import numpy as np
import pytest

from treeline.llm import op13_whitening as op


def brute(rows, wanted=4):
    """Exact deviations and numpy's eigenvectors of the covariance of the distinct integer vectors."""
    kept = [(i, [int(np.floor(256.0 * c)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max(len(v) for _, v in kept)
    kept = [(i, v + [0] * (d - len(v))) for i, v in kept]
    fit = np.array(sorted({tuple(v) for _, v in kept}), float)
    n, s = len(fit), [sum(col) for col in zip(*{tuple(v) for _, v in kept})]
    c = fit - np.array([t / n for t in s])
    cov = c.T @ c / n
    value, vec = np.linalg.eigh(cov)
    return kept, n, s, value[::-1][:wanted], vec[:, ::-1][:, :wanted], np.trace(cov)


def held(df, rows, wanted=4):
    kept, n, s, value, vec, trace = brute(rows, wanted)
    got = df.collect()
    ids = sorted([i for i, _ in kept] * len(value), key=str)
    assert sorted((r.vec_id for r in got), key=str) == ids
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    flip = None
    for i, v in kept:
        own = by[i]
        dev = sum((n * a - b) ** 2 for a, b in zip(v, s))
        w = np.array([own[k + 1].whitened for k in range(len(value))])
        want = (np.array(v, float) - np.array([t / n for t in s])) @ vec / np.sqrt(value)
        if flip is None:
            flip = np.sign(w) * np.sign(want)
        assert np.allclose(w, want * flip, rtol=1e-9, atol=1e-9)
        for k in range(len(value)):
            r = own[k + 1]
            assert r.n == n and r.deviation == (dev if dev < 2 ** 63 else None) and int(r.deviation_decimal) == dev
            assert r.explained == pytest.approx(value[k] / trace, rel=1e-9) and r.identity_error < 1e-9


def test_against_brute_force(llm):
    rng = np.random.default_rng(3)
    mix = rng.standard_normal((50, 50)) * np.linspace(1.5, 0.4, 50)
    x = rng.standard_normal((700, 50)) @ mix / 5 + 0.3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[7].tolist()) for i in range(300)]
    rows += [(2000, None), (2001, [1.0] * 49 + [None]), (2002, [1.0] * 49 + [float("nan")]), (2003, [float("inf")] + [0.0] * 49), (2004, x[8].tolist()), (2005, [-0.0] * 50), (2006, [])]
    df = llm.createDataFrame([(i, v, 1, "y") for i, v in rows], "vec_id long, embedding array<double>, n int, component string")
    held(op.whitened(df.repartition(5)), rows)


def test_floats_table(llm):
    emb = llm.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in emb.collect()]
    held(op.whitened(emb), rows)


@pytest.mark.parametrize("spectrum", ["decay", "flat", "low rank", "two equal", "steep"])
def test_leading(spectrum):
    rng, d = np.random.default_rng(1), 300
    e = {"decay": 1 / np.arange(1, d + 1), "flat": 1 + 1e-4 * rng.random(d), "low rank": np.r_[5.0, 3, 2, 1.5, 1, np.zeros(d - 5)],
         "two equal": np.r_[4.0, 4, 3, 3, np.linspace(2, 1, d - 4)], "steep": 10.0 ** -np.arange(d).clip(0, 12)}[spectrum]
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    passes = []
    value, vec, residual = op.leading(lambda y: passes.append(1) or v @ y, d)
    assert np.allclose(value, np.sort(e)[::-1][:4], rtol=1e-10, atol=1e-13)
    assert np.allclose(vec.T @ vec, np.eye(4), atol=1e-12) and residual.max() <= 1e-12 * value[0]
    assert len(passes) < 700


def test_exact_deviations():
    rng = np.random.default_rng(2)
    for top, n, s in ((1500, 51_282, 10 ** 7), (2 ** 20, 10 ** 12, 2 ** 61), (2 ** 62, 10 ** 9, 2 ** 85)):
        x = rng.integers(-top, top, (20, 64))
        t = [int(rng.integers(-2 ** 30, 2 ** 30)) * (s >> 30) for _ in range(64)]
        assert op.deviations(x, n, t) == [sum((n * int(a) - b) ** 2 for a, b in zip(r, t)) for r in x]


def test_few_and_odd_rows(llm):
    schema = "vec_id long, embedding array<float>, label int"
    assert op.whitened(llm.createDataFrame([], schema)).count() == 0
    assert op.whitened(llm.createDataFrame([(1, None, 1), (2, [float("nan")], 2)], schema)).count() == 0
    assert op.whitened(llm.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)], schema)).count() == 0
    assert op.whitened(llm.createDataFrame([(1, [], 1)], schema)).count() == 0
    rows = [(1, [1.0, 2.0]), (None, [3.0, 2.0]), (3, [1e300, 0.5])]
    got = op.whitened(llm.createDataFrame(rows[:2], "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.component, round(abs(r.whitened), 9), r.deviation) for r in got} == {(1, 1, 1.0, 512 ** 2), (None, 1, 1.0, 512 ** 2)}
    assert op.whitened(llm.createDataFrame(rows, "vec_id long, embedding array<double>")).count() >= 3
