"""The stored index: segments, refresh, merge, search."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from treeline.operators import segments, text_index
from treeline.session import scratch_path

POSTING = ["doc_id", "field", "pos", "token", "dl"]


def _docs(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")


def _rows(df):
    return sorted(tuple(r) for r in df.select(*POSTING).collect())


def _bytes(path, segment):
    total = 0
    for name in ("postings", "tokens", "documents", "gone", "stats"):
        for root, _, files in os.walk(f"{path}/{name}/segment={segment}"):
            total += sum(os.path.getsize(os.path.join(root, f)) for f in files if f.endswith(".parquet"))
    return total


def _texts(n, seed=1):
    rng = random.Random(seed)
    words = ["the"] * 30 + ["on"] * 10 + [f"w{i}" for i in range(200)]
    return {i: " ".join(rng.choice(words) for _ in range(rng.randrange(40))) for i in range(n)}


def test_refresh_writes_only_changes_and_equals_a_rebuild(spark):
    path, texts = scratch_path(spark, "stage-segments"), _texts(300)
    first = segments.add_segment(spark, path, _docs(spark, texts))
    assert first.documents == 300 and _rows(segments.current(spark, path, "postings")) == _rows(text_index.build_postings(_docs(spark, texts)))
    assert segments.refresh(spark, path, _docs(spark, texts)) is None
    for i in (3, 7):
        texts[i] = "the on the on brand new words"
    del texts[11]
    texts[1000] = "on the"
    second = segments.refresh(spark, path, _docs(spark, texts))
    assert (second.id, second.documents) == (2, 3)
    assert second.postings == 7 * 2 + 2 and _bytes(path, 2) < _bytes(path, 1) / 2
    assert spark.read.parquet(f"{path}/postings").where("segment = 2").select("doc_id").distinct().count() == 3
    assert _rows(segments.current(spark, path, "postings")) == _rows(text_index.build_postings(_docs(spark, texts)))
    # removal alone
    del texts[20]
    assert segments.refresh(spark, path, _docs(spark, texts)).documents == 0
    assert _rows(segments.current(spark, path, "postings")) == _rows(text_index.build_postings(_docs(spark, texts)))


def test_merge_equals_rebuild_and_search_equals_scan(spark):
    path, texts = scratch_path(spark, "stage-segments"), {}
    for part in range(5):
        new = {100 * (part % 4) + i: t for i, t in _texts(100, part).items()}  # the last part replaces the first
        texts.update(new)
        segments.add_segment(spark, path, _docs(spark, new), heavy=50, buckets=8)

    def check():
        docs = _docs(spark, texts)
        assert _rows(segments.current(spark, path, "postings")) == _rows(text_index.build_postings(docs))
        for phrase in (["the", "on"], ["the"], ["w5", "the"], ["the", "the", "on"], ["no", "such"]):
            want = {r.doc_id: (r.tf, r.dl, round(r.score, 9)) for r in text_index.phrase_search_scan(docs, "", 1000, phrase=phrase).collect()}
            got = {r.doc_id: (r.tf, r.dl, round(r.score, 9)) for r in segments.phrase_search(spark, path, "", 1000, phrase=phrase).collect()}
            assert got == want
    check()
    made = segments.merge(spark, path, buckets=4, heavy=50)
    assert made and len(segments.visible(segments.committed(spark, path))) < 4
    check()
    assert segments.vacuum(spark, path) and segments.merge(spark, path) == []
    texts[0] = "the on again"
    segments.refresh(spark, path, _docs(spark, texts))
    check()


def test_a_stop_word_is_dealt_over_buckets(spark):
    path = scratch_path(spark, "stage-segments")
    texts = {i: "the " * 20 + f"x{i % 50}" for i in range(400)}
    segments.add_segment(spark, path, _docs(spark, texts), buckets=8, heavy=500)
    per = spark.read.parquet(f"{path}/postings").where("token = 'the'").groupBy("bucket").count().collect()
    sizes = sorted(r["count"] for r in per)
    assert len(sizes) == 8 and sizes[-1] <= 4 * sizes[len(sizes) // 2]


def test_rare_tokens_come_first_and_only_their_buckets_are_read(spark):
    path = scratch_path(spark, "stage-segments")
    texts = {i: "the on " * 20 + ("needle" if i == 7 else f"x{i}") for i in range(300)}
    segments.add_segment(spark, path, _docs(spark, texts))
    got = segments.hits(spark, path, ["on", "needle"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id for r in got.collect()} == {7} and got.count() == 21
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "PushedFilters: [IsNotNull(token), EqualTo(token,needle)" in plan


def test_an_incomplete_segment_does_not_count(spark):
    path, texts = scratch_path(spark, "stage-segments"), _texts(50)
    segments.add_segment(spark, path, _docs(spark, texts))
    want = _rows(segments.current(spark, path, "postings"))
    # a crash after the postings of segment 2 were written
    text = _docs(spark, {1: "half a segment"})
    segments._write_postings(text_index.build_postings(text), path, 2, 4, 100)
    assert _rows(segments.current(spark, path, "postings")) == want
    segments.add_segment(spark, path, text)
    texts[1] = "half a segment"
    assert _rows(segments.current(spark, path, "postings")) == _rows(text_index.build_postings(_docs(spark, texts)))


def test_nulls_and_empty(spark):
    path = scratch_path(spark, "stage-segments")
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "the on"), (4, "the on")], "doc_id long, text string")
    segments.add_segment(spark, path, docs)
    assert segments.corpus_stats(spark, path).first().asDict() == {"n_docs": 3, "avgdl": pytest.approx(2 / 3)}
    assert [r.doc_id for r in segments.phrase_search(spark, path, "the on").collect()] == [4]
    none = scratch_path(spark, "stage-segments")
    segments.add_segment(spark, none, docs.limit(0))
    assert segments.phrase_search(spark, none, "the on").count() == 0


def test_no_token_document_pairs_are_grouped_and_files_are_sorted(spark, monkeypatch):
    """Counts come from a document's own array, postings are sorted by the tasks that hold their documents."""
    arrays = text_index.token_arrays(_docs(spark, dict(enumerate(["b a b", "a", "", "c b"]))))
    counts = text_index.token_counts(arrays)
    assert sorted(tuple(r) for r in counts.collect()) == [("a", 2, 2), ("b", 2, 3), ("c", 1, 1)]
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.split("\n") if "hashpartitioning" in line and "doc_id" in line] == []

    path = scratch_path(spark, "index")
    monkeypatch.setattr(segments, "TASK_POSTINGS", 40)
    segments.add_segment(spark, path, _docs(spark, {i: f"w{i % 7} x{i} w{i % 7} y" for i in range(60)}), buckets=2, heavy=50)
    files = [r[0] for r in spark.read.parquet(f"{path}/postings").select(F.input_file_name()).distinct().collect()]
    assert len(files) > 6
    for f in files:
        got = [(r.token, r.doc_id, r.field, r.pos) for r in spark.read.parquet(f).collect()]
        assert got == sorted(got)


def test_merged_dictionary_leaves_gone_documents_out(spark):
    path = scratch_path(spark, "index")
    for part in range(4):
        segments.add_segment(spark, path, _docs(spark, {0: "a b", 1: "b c c", 2: "d"} if part == 0 else {0: "a b", 10 + part: "e e e e"}))
    (made,) = segments.merge(spark, path, tier=4)
    got = segments._table(spark, path, "tokens", [made.id]).select("token", "df", "postings").collect()
    assert sorted(tuple(r) for r in got) == [("a", 1, 1), ("b", 2, 2), ("c", 1, 2), ("d", 1, 1), ("e", 3, 12)]
    assert made.postings == 18 and made.documents == 6
