from __future__ import annotations

import pytest

SAMPLE = "/root/testdata/sf0.01"
LONG = "lorem ipsum dolor sit amet " * 8000
MESSY = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a", 73),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t ", "en", None, 4),
    (5, LONG, "en", "a", len(LONG)),
    (6, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "b", 73),
    (7, "word", "en", "b", 4),
    (8, "été漢字 ▁ \x00 😀", "fr", "b", 11),
    (8, "été漢字 ▁ \x00 😀", "fr", "b", 11),
    (None, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "b", 73),
    (None, None, None, None, None),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True, scope="session")
def package_on_executors(spark):
    from tallymatch.llm.storage import on_executors

    on_executors(spark)


@pytest.fixture()
def messy(spark):
    """Null, empty, long, repeated and odd rows, with extra columns named like those the operators use inside."""
    docs = spark.createDataFrame(MESSY, COLUMNS)
    extra = ["key", "rep", "node", "component", "cluster", "part", "n", "score", "toxic", "digest", "label", "words", "kept", "ids", "hole_doc", "DOC"]
    return docs.selectExpr("*", *[f"'x' as {c}" for c in extra])


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture()
def labels(spark):
    return spark.read.parquet(f"{SAMPLE}/labels.parquet")


@pytest.fixture()
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture()
def documents(spark):
    return spark.read.parquet(f"{SAMPLE}/documents.parquet")
