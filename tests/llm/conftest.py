import pytest
from llm_helpers import extra


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    some = " ".join(f"word{i} and" for i in range(60))
    return [(1, some, "en", "s", 1), (1, some, "en", "s", 1), (2, None, "en", "s", None), (3, "", None, None, 0),
            (4, long, "en", "s", None), (5, some + " more", "en", "s", 5), (6, some + " more", "en", "s", 5),
            (None, "a text without id " * 20, None, None, None), (None, None, None, None, None), (7, "\n\n \n", "en", "s", 3),
            (8, "one", "en", "s", 3), (9, "é ü 漢字 " * 40, "fr", "s", 200), (10, "x" * 5000, "en", "s", 5000),
            (11, "same line here for all of us now\nother " + some + "\nsame line here for all of us now", "en", "s", 9)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return extra(spark.createDataFrame(odd_rows, SCHEMA).repartition(3)).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
