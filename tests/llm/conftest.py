import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture
def odd(spark):
    """Nulls, empty and blank texts, a very long text, ties, repeated rows and columns whose names clash."""
    long_text = "alpha beta gamma delta " * 40_000
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, long_text), (5, "same words in this text " * 12), (6, "same words in this text " * 12), (7, "x" * 5_000), (7, "x" * 5_000), (None, "a text without a name"), (None, None), (8, "été 日本語 \U0001f600 ﬁ ▁ a  b ")]
    extra = [(i, t, None if i == 3 else "en", "s", 0, 1, 2, "c", None) for i, t in rows]
    return spark.createDataFrame(extra, DOCS + ", fp long, h1 long, kept string, _row string")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)
