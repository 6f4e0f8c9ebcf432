import os

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = "lorem ipsum dolor " * 40_000


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and names that operators use inside."""
    rows = [
        (1, "one two three four five six seven", "en", "a"),
        (1, "one two three four five six seven", "en", "a"),
        (2, "one two three four five six seven", "en", None),
        (3, None, None, None),
        (4, "", "en", "a"),
        (5, " \t\n ", "en", "b"),
        (None, "one two three four five six seven", "en", "a"),
        (None, None, None, None),
        (6, LONG, "xx", "b"),
        (7, "1234 !? 99", "en", "b"),
        (8, "\U0001f600 é ▁ <s> 世界", "xx", "a"),
        (9, "two words", "xx", "a"),
    ]
    names = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, names)
    for k, name in enumerate(("n", "digest", "u", "v", "label", "sig", "ids", "score", "found", "kept", "part", "token", "media", "at", "id", "h1")):
        df = df.selectExpr("*", f"{k} AS `{name}`")
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
