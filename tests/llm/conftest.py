import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, node string, score string, kept string, piece string, digest string, mentions string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names clash with those that operators make."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", None, None, "x", None, "y", None, "z", None, None) for i, t in zip(ids, texts, strict=True)], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, ties, repeats, controls, other scripts, a long word and a long text."""
    long = " ".join(f"w{i % 977}.{i % 31}" for i in range(30_000))
    return [None, "", " \n\t ", "word", "a a a a a a", "same text here now ok", "same text here now ok", "café  naïve\tﬁn x", "中文 文本 текст", "x" * 70_000, "<|endoftext|> </s>[INST] \\l \\b \\", long, long, "\x00\x01   \U0001f600"]
