import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, slot int, leaks string, node long, row_number int, quality_score int, found_lang string, leaks_found int, row_id int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns with
    the names that operators give to results."""
    words = "The and attion to thanedble the, anea. Eriner thanea and ondthe worth in."
    rows = [
        (1, words), (2, words), (3, words.upper()), (3, words.upper()), (None, words), (None, None), (4, None), (5, ""), (6, "   "), (7, "a"),
        (8, "two words"), (9, "12 34 !!"), (10, (words + "\n") * 4000), (11, "  lead  double \n\n space "), (12, "日本 語 ünïcode é"), (13, "x" * 70_000), (None, None),
    ]
    return spark.createDataFrame([(i, t, "en", None, None, 0.5, 9, 9, "x", 1, 1, 1, "l", 1, 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
