import pytest


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, a column whose name clashes with internal ones."""
    long = " ".join(f"w{i * 7919 % 1000}" for i in range(30_000))
    rows = [(1, "a b"), (2, None), (3, ""), (4, long), (5, "a b"), (5, "a b"), (6, "  x\n\ny <|endoftext|> z "), (7, "é́ ΑΣ İ\x1cq　w"), (None, "no id")]
    return spark.createDataFrame([(i, t, "x", None) for i, t in rows], "doc_id long, text string, n string, bin string")
