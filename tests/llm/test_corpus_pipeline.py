import importlib
import random
import sys
import zlib

import public_tokenizers
import pytest

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import corpus_pipeline  # noqa: E402
from treeline.llm.pretokens import load  # noqa: E402

W = [f"word{i}" for i in range(300)]


def build(rng):
    """Clean documents, and planted ones: rude, with repeated lines, near copies, leaks."""
    def prose(n):
        return " ".join(rng.choice(W) for _ in range(n))
    docs, labels = {}, []
    for i in range(160):
        docs[i] = "\n".join(prose(rng.randrange(12, 40)) for _ in range(3))
        labels.append((i, 1, 0))
    for i in range(160, 220):
        docs[i] = prose(30) + " vileterm " + prose(20)
        labels.append((i, 1, 1))
    line = prose(20)
    for i in range(220, 224):
        docs[i] = prose(25) + "\n" + line + "\n" + prose(25)
    base = prose(400)
    docs[230], docs[231] = base, base + "."
    bench = [(1, prose(25)), (2, prose(4))]
    docs[240] = prose(15) + " " + bench[0][1] + " " + prose(15)
    return docs, labels, bench, line


def test_stages_against_planted_cases(llm, tmp_path):
    docs, labels, bench, line = build(random.Random(12))
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()]
    d = str(tmp_path)
    llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    llm.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    llm.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now, seen = llm.read.parquet(f"{d}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(llm, now, d)
        if k < 4:
            assert out.columns == now.columns
        out.write.parquet(f"{d}/out{k}")
        now = llm.read.parquet(f"{d}/out{k}")
        seen[name] = now.collect()
    ids = [{r.doc_id for r in seen[n]} for n, _ in corpus_pipeline.STAGES]
    assert ids[0] == set(docs) - set(range(160, 220))
    text = {r.doc_id: r for r in seen["line dedup"]}
    assert ids[1] == ids[0] and line in text[220].text
    assert all(line not in text[i].text and text[i].text.count("\n") == 1 for i in range(221, 224))
    assert all(r.n_chars == len(r.text) for r in text.values())
    assert text[231].text == "" and text[230].text == docs[230]
    assert ids[2] == ids[1]
    assert ids[3] == ids[2] - {240}
    t = load(public_tokenizers.path("word_bpe_49k.json"))
    kept = {r.doc_id: r.text for r in seen["benchmark decontamination"]}
    assert sum(r.length for r in seen["best-fit packing"]) == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for x in kept.values())
    total = corpus_pipeline.run(llm, d)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, total.select(key).collect())) == sorted(tuple(r[c] for c in key) for r in seen["best-fit packing"])


def test_near_copies_after_other_stages(llm):
    rng = random.Random(3)
    base = [rng.choice(W) for _ in range(600)]
    near = list(base)
    near[300] = "changed"
    rows = [(1, " ".join(near)), (0, " ".join(base)), (2, " ".join(rng.choice(W) for _ in range(600))), (None, None), (5, "")]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.simhash_dedup(llm, docs, "")
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [0, 2, 5] or sorted((r.doc_id for r in kept.collect()), key=str) == [0, 1, 2, 5]


def test_empty_tables(llm, tmp_path):
    d = str(tmp_path)
    docs = llm.createDataFrame([], "doc_id long, text string, n_chars long, extra string")
    llm.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    llm.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(llm, docs, d)
        assert out.count() == 0
        docs = docs if name == "best-fit packing" else out


def test_entry_lists_all():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= names
    assert sum(n.startswith("op") and n[2].isdigit() for n in names) == 13
    assert "op10_decontamination" in entry.oracle_sql()
