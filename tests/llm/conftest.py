import pytest

#: null and empty texts, white space only, one and two words, repeated rows, null ids, non-Latin text, a long one
TEXTS = [None, "", " \t\n ", "one", "one two", "Straße über Äpfel 東京 🙂 x", "same words in this very text", "same words in this very text", "y " * 30_000]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Awkward rows, and columns whose names clash with those that operators use inside."""
    rows = [(i if i != 3 else None, t, "en", None, i, "clash", float(i), None) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], "en", None, 7, "clash", 0.0, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score double, n int")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
