import public_tokenizers
import pytest

from treeline.llm import op4_token_counts as op
from treeline.llm.pretokens import load

SMOKE = "/root/testdata/sf0.001"


def truth(texts):
    t = load(public_tokenizers.path(op.VOCABULARY))
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_matches_library_on_odd_texts(fixture_docs):
    rows = op.count_tokens(fixture_docs).select("text", "n_tokens", "tokens").collect()
    assert len(rows) == 11
    assert [r.tokens.n_tokens for r in rows] == truth([r.text for r in rows])
    assert all(r.tokens.n_bytes == len((r.text or "").encode()) for r in rows)
    assert all(r.tokens.over_limit == (r.tokens.n_tokens > 1024) for r in rows)


def test_query_matches_library(llm):
    from treeline.llm.registry import QUERIES

    got = {r.doc_id: r for r in QUERIES["op4_token_counts"](llm, SMOKE).collect()}
    docs = llm.read.parquet(f"{SMOKE}/documents.parquet").collect()
    assert [got[d.doc_id].n_tokens for d in docs] == truth([d.text for d in docs])


def test_empty_table(llm, fixture_docs):
    assert op.count_tokens(fixture_docs.limit(0)).count() == 0
