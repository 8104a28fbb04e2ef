import pytest

from treeline.llm.common import prepare


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def fixture_docs(llm):
    """Odd documents: nulls, empty and long texts, repeated rows, a clashing extra column."""
    rows = [(1, "The quick brown fox jumps over the lazy dog.", "a"), (2, None, "b"), (3, "", "c"),
            (4, "word " * 3000, "d"), (5, "x" * 20000, "e"), (6, "Ünïcödé ²³ 漢字 🙂 é\tTab\r\n  two  spaces ", "f"),
            (7, "The quick brown fox jumps over the lazy dog.", "g"), (8, " lead <|endoftext|> it's 12,345.67 \x1c\x85 end", "h"),
            (8, " lead <|endoftext|> it's 12,345.67 \x1c\x85 end", "h"), (None, "no id", None), (10, "a\nb\n\nc d", "i")]
    return llm.createDataFrame(rows, "doc_id long, text string, n_tokens string")
