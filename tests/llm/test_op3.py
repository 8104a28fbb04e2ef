import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from treeline.llm import op3_packing as op
from treeline.llm.pretokens import load

SMOKE = "/root/testdata/sf0.001"


def valid(rows, size=2048):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(seqs)


def pieces_of(docs):
    t = load(public_tokenizers.path(op.VOCABULARY))
    out = []
    for d, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for j, s in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[s:s + 2048], "<u4")
            out.append((d, j, s, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


def test_query(llm):
    from treeline.llm.registry import QUERIES

    rows = QUERIES["op3_packing"](llm, SMOKE).collect()
    docs = [(r.doc_id, r.text) for r in llm.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == pieces_of(docs)
    assert valid(rows) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_odd_documents(llm, fixture_docs):
    rows = op.pack(op.cut_pieces(fixture_docs, ids=True)).collect()
    docs = [(r.doc_id, r.text) for r in fixture_docs.collect()]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == pieces_of(docs)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    valid(rows)
    assert op.pack(op.cut_pieces(fixture_docs.limit(0))).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_all_and_wastes_little(seed):
    rng = np.random.default_rng(seed)
    size = 256
    lengths = np.clip(rng.lognormal(3.5 + seed % 3 / 2, 1, 20000).astype(int), 1, size)
    h = np.bincount(lengths, minlength=size + 1)
    total = np.zeros(size + 1, int)
    n = 0
    for contents, count in op.plan(h, size):
        assert sum(a * k for a, k in contents) <= size
        n += count
        for a, k in contents:
            total[a] += k * count
    assert (total == h).all()
    best = op.best_fit(h, size)
    assert n <= 1.002 * max(sum(c for _, c in best), -(-lengths.sum() // size)) + 1


def test_hot_length(llm):
    rng = random.Random(1)
    rows = [(i, 0, 1 if i % 3 else rng.randrange(1, 2049)) for i in range(5000)]
    df = llm.createDataFrame(rows, "doc_id long, piece int, length long")
    out = op.pack(df).collect()
    assert len(out) == 5000
    h = np.bincount([r[2] for r in rows], minlength=2049)
    assert valid(out) <= sum(c for _, c in op.best_fit(h, 2048))


def test_the_arrow_pattern_finds_the_same_characters():
    import pyarrow as pa
    import pyarrow.compute as pc

    from treeline.llm import pretokens

    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000] + ["<|", "<", "|", "a<|b"]
    slow = pc.match_substring_regex(pa.array(chars), pretokens._SLOW_ARROW).to_pylist()
    assert slow == [not pretokens.plain(c) for c in chars]
