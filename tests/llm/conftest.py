import pytest

LONG = "word%d " * 3000 % tuple(range(3000))
#: Nulls, empty and long texts, ties, repeated rows; the extra columns clash with names used inside.
ODD = [
    (1, "a b c d", "en", "s1", 7, "x"),
    (1, "a b c d", "en", "s1", 7, "x"),
    (2, "a b c d", None, "s2", 7, None),
    (None, "token = 'abcdef123456' é", "en", None, None, "y"),
    (3, None, "en", "s1", 0, "z"),
    (4, "", "en", "s1", 0, "z"),
    (5, " \t\n\x0b\x0c\r ", "en", "s1", 0, "z"),
    (6, LONG, "en", "s3", len(LONG), "z"),
    (7, "ÄÖ ß 日本語 👍🏽 \x00 end", "de", "s3", 12, "z"),
    (8, "same same same same\nsame same same same", "en", "s3", 39, "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {extra} string"


@pytest.fixture(scope="session")
def odd(spark):
    return lambda extra="size": spark.createDataFrame(ODD, SCHEMA.format(extra=extra))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA.format(extra="row"))


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
