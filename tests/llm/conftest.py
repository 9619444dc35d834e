import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, copies int, score double"


@pytest.fixture
def odd(spark):
    """Documents with nulls anywhere, empty and long texts, ties, repeated rows and clashing extra columns."""
    long = "many words of a very long text that goes on and on " * 3000
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t", None, None, 3), (4, "one", "de", "b", 3), (5, long, "en", "a", len(long)),
        (6, long, None, "b", len(long)), (7, "x" * 200_000, "en", "", 200_000), (None, "a text without an id, see the MIT License", "en", None, 5), (8, "123 456 !!", "fr", "b", 9),
        (9, "der die das und ein text", "de", "c", 9), (9, "der die das und ein text", "de", "c", 9), (10, "the and of a text in it", "en", "c", 9), (11, "été où çà \U0001f600 ни 漢字", "fr", "c", 9),
    ]
    return spark.createDataFrame([(*r, "k", 3, 0.5) for r in rows], SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
