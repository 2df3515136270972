import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich. " * 4000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again\nshared line of some length\nshort", "en", "a", 1),
    (2, "  Shared LINE of some length \nAnother text that says something else entirely", "en", "a", 1),
    (3, None, "en", "b", 0),
    (4, "", None, "b", 0),
    (5, "   \n\t", "de", None, 5),
    (6, LONG, "de", "b", len(LONG)),
    (7, "The quick brown fox jumps over the lazy dog again and again\nshared line of some length\nshort", None, None, 1),
    (7, "The quick brown fox jumps over the lazy dog again and again\nshared line of some length\nshort", None, None, 1),
    (8, "漢字 かな 가나다 <|endoftext|> it's 123,456.78\x1c\x1d x", "en", "", 1),
    (9, "1234 5678 !!!", "en", "c", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and a clashing extra column of each result's name."""
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
