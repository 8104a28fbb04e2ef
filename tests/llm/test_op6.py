import random

import xxhash

from treeline.llm import op6_simhash as op
from treeline.llm.common import read

SMOKE = "/root/testdata/sf0.001"


def brute_fp(text, k=4):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    s = [" ".join(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_groups(fps):
    """doc_id -> smallest reachable; fps: (doc_id, fp)."""
    comp = {}
    left = dict(enumerate(fps))
    while left:
        queue, seen = [left.popitem()], []
        while queue:
            i, x = queue.pop()
            seen.append((i, x))
            near = [j for j, y in left.items() if (x[1] ^ y[1]).bit_count() <= 4]
            queue += [(j, left.pop(j)) for j in near]
        ids = [x[0] for _, x in seen if x[0] is not None]
        for i, _ in seen:
            comp[i] = min(ids, default=None)
    return [comp[i] for i in range(len(fps))]


def test_query_against_brute_force(llm):
    from treeline.llm.registry import QUERIES

    got = {r.doc_id: r for r in QUERIES["op6_simhash"](llm, SMOKE).collect()}
    docs = read(llm, SMOKE, "documents").collect()
    fps = [(d.doc_id, brute_fp(d.text)) for d in docs]
    assert [got[d].fingerprint for d, _ in fps] == [f"{f:016x}" for _, f in fps]
    assert [got[d].component_id for d, _ in fps] == brute_groups(fps)


def points(spark, seed, n=400):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(12)]
    out = {0, (1 << 64) - 1}
    for _ in range(n):
        x = rng.choice(base)
        for b in rng.sample(range(64), rng.randrange(9)):
            x ^= 1 << b
        out.add(x)
    rows = sorted(x - (1 << 64) if x >> 63 else x for x in out)
    return rows, spark.createDataFrame([(x,) for x in rows], "fp long")


def check_links(spark, most):
    from treeline.llm.components import components

    rows, df = points(spark, 11)
    found = op.near_links(df, 4, most).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in found) or most < 4096
    comp = {r.node: r.component for r in components(spark.createDataFrame(found, "a long, b long")).collect()}
    want = brute_groups([(x, x & (1 << 64) - 1) for x in rows])
    assert [comp.get(x, x) for x in rows] == want


def test_links_lose_nothing(llm):
    check_links(llm, 4096)


def test_links_of_hot_keys(llm):
    check_links(llm, 8)


def test_odd_rows_and_keep_one(llm, fixture_docs):
    rows = op.near_groups(fixture_docs).collect()
    assert len(rows) == 11
    assert {r.doc_id: r.component_id for r in rows if r.doc_id in (1, 2, 3, 7)} == {1: 1, 7: 1, 2: 2, 3: 2}
    kept = op.keep_one(fixture_docs)
    assert kept.columns == fixture_docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 2, 4, 5, 6, 8, None, 10], key=str)
    assert op.keep_one(fixture_docs.limit(0)).count() == 0
    nulls = llm.createDataFrame([(None, "a b"), (None, "a b"), (None, "c d e f g"), (None, None)], "doc_id long, text string")
    assert op.keep_one(nulls).count() == 3
