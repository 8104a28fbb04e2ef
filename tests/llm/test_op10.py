import hashlib
import random
import re

from treeline.llm import op10_decontamination as op

W = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for t in docs:
        w, hit, ids = split(t), set(), set()
        for item, text in items:
            b = split(text)
            n = min(10, len(b))
            for i in range(len(b) - n + 1) if b else ():
                for j in range(len(w) - n + 1):
                    if w[j:j + n] == b[i:i + n]:
                        hit |= set(range(j, j + n))
                        ids.add(str(item))
        out.append((len(w), len(hit), sorted(ids)))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = op.benchmark_matches(d, b).orderBy("doc_id").collect()
    return [(r.leak.n_words, sum(s.stop - s.start for s in r.leak.spans), list(r.leak["items"])) for r in rows], d, b


def test_brute_force(llm):
    rng = random.Random(5)
    vocab = ["a", "b", "Ça", "d1", "the"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([12, 30, 3, 1, 0, 10, 15, 40])]
    items += [(8, None), (0, "the the the the the the the the the the the")]
    for use in (items, [x for x in items if len(split(x[1])) >= 10]):
        docs = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(80))) for _ in range(60)]
        docs += [None, "", "THE-THE, " * 30, use[0][1].upper(), "zz " + use[1][1].replace(" ", "\n.") + " zz", use[0][1]]
        got, _, _ = run(llm, docs, use)
        assert got == brute(docs, use)


def test_blocks_agree_and_filter(llm, monkeypatch):
    rng = random.Random(9)
    items = [(k, " ".join(f"w{rng.randrange(30)}" for _ in range(25))) for k in range(20)]
    docs = [f"{rng.random()} {items[rng.randrange(20)][1]} x {items[rng.randrange(20)][1][:40]}" if rng.random() < .5 else "clean words only" for _ in range(40)]
    one, _, _ = run(llm, docs, items)
    monkeypatch.setattr(op, "BLOCK_BYTES", 400)
    many, d, b = run(llm, docs, items)
    assert one == many == brute(docs, items)
    kept = op.decontaminate(d, b)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, x in enumerate(one) if not x[1]}


def test_empty_tables(llm):
    assert run(llm, ["a b"], [])[0] == [(2, 0, [])]
    d = llm.createDataFrame([], "doc_id long, text string")
    assert op.benchmark_matches(d, llm.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_longest_match(llm):
    text = " ".join(f"w{i}" for i in range(30))
    d = llm.createDataFrame([(1, "x y " + " ".join(f"w{i}" for i in range(4, 21)) + " z")], "doc_id long, text string")
    b = llm.createDataFrame([(1, text)], "item_id long, text string")
    r = op.benchmark_matches(d, b).first().leak
    assert (r.longest, r.spans[0].start, r.spans[0].stop) == (17, 2, 19)
    assert hashlib.sha256(b"").hexdigest()
