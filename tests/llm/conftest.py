import pytest


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows, and columns whose names the operators use themselves."""
    names = "doc_id long, text string, lang string, source string, n_chars long, row string, near string, sha string, key string, fp long, kept boolean, id long"
    rows = [(1, "same text", "en"), (1, "same text", "en"), (2, "same  text", None), (3, None, "en"), (4, "", "en"), (None, "same text", "en"), (5, "long word " * 30000, "en"), (6, "x" * 100000, "en"), (7, "mit license", "en")]
    return spark.createDataFrame([(i, t, g, None, None, "r", "n", "s", "k", 5, True, 9) for i, t, g in rows], names)


@pytest.fixture
def empty(odd):
    return odd.where("false")
