import random
import re
from collections import Counter

import pytest

from treeline.llm import op11_collocations as op


def brute(rows, support=10, percent=50, top=2000, longest=3):
    """rows: (text, lang).  Same rules, in plain Python."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= support}
    most = Counter()
    for (lang, ws), a in cand.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                most[lang, ws[i:i + k]] = max(most[lang, ws[i:i + k]], a)
    out = {}
    for (lang, ws), a in cand.items():
        if (lang, ws) in most and 100 * most[lang, ws] >= percent * a:
            continue
        s, _, l, r = min((1000000 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
        out.setdefault(lang, []).append((-s, -a, " ".join(ws).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top])}


def rows_of(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    vocab = ["the", "of", "New", "York", "City", "straße", "漢字", "a-b", "x\x85y", "é", "\xa0", "und"] + [f"w{i}" for i in range(30)]
    out = []
    for d in range(n):
        words = [rng.choice(vocab[:rng.choice((6, 12, 42))]) for _ in range(rng.randrange(30))]
        out.append((d, "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", "!"]) for w in words), rng.choice(["en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("support, percent, top, longest", [(10, 50, 2000, 3), (3, 80, 15, 4), (1, 50, 2000, 2)])
def test_against_brute_force(llm, support, percent, top, longest):
    docs = corpus()
    df = llm.createDataFrame([(d, t, g, "x") for d, t, g in docs], "doc_id long, text string, lang string, phrase string").repartition(5)
    want = brute([(t, g) for _, t, g in docs], support, percent, top, longest)
    assert rows_of(op.collocations(df, support, longest, percent, top)) == want and len(want) > 10


def test_long_texts_are_parted_between_pieces(llm, monkeypatch):
    docs = [(1, "alpha beta gamma. " * 400 + "delta " * 900, "en"), (2, None, "en"), (3, "", None), (4, "alpha beta gamma. " * 5, "en"), (4, "alpha beta gamma. " * 5, "en")]
    parts = list(op._parts(docs[0][1].encode().translate(op._PLAIN)))
    assert len(parts) == 1
    monkeypatch.setattr(op, "CHUNK_BYTES", 100)
    parts = list(op._parts(docs[0][1].encode().translate(op._PLAIN)))
    assert len(parts) > 60 and b"\n".join(parts) == docs[0][1].encode().translate(op._PLAIN)
    df = llm.createDataFrame([(d, t, g) for d, t, g in docs], "doc_id long, text string, lang string")
    assert rows_of(op.collocations(df)) == brute([(t, g) for _, t, g in docs])


def test_a_full_filter_changes_no_row(llm, monkeypatch):
    docs = corpus(200, 2)
    df = llm.createDataFrame(docs, "doc_id long, text string, lang string")
    monkeypatch.setattr(op, "filter_of", lambda keys: __import__("numpy").full(op.FILTER_BITS // 8, 255, "uint8"))
    assert rows_of(op.collocations(df)) == brute([(t, g) for _, t, g in docs])


def test_large_counts_are_exact(llm):
    a = 3_000_000_000_000
    counts = llm.createDataFrame([("en", 1, "x", a + 7), ("en", 1, "y", a + 9), ("en", 2, "x y", a)], "lang string, size int, phrase string, f long")
    r = op.scored(counts).first()
    assert r.score == 1000000 * a * a // ((a + 7) * (a + 9)) and (r.l, r.r) == (a + 7, a + 9)


def test_empty(llm):
    assert op.collocations(llm.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    assert op.collocations(llm.createDataFrame([(None, None, None)], "doc_id long, text string, lang string")).count() == 0
