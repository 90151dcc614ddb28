import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a long text and other scripts; extra columns whose names clash with those inside operators."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    same = "the same words stand here twice and that is all there is to say about it now"
    rows = [
        (1, same, "en", "s", 9),
        (1, same, "en", "s", 9),
        (2, same, None, None, None),
        (3, None, "en", "s", 0),
        (4, "", "en", "s", 0),
        (5, " \t\n ", "en", "s", 4),
        (6, long, "en", "s", len(long)),
        (None, "a text without an id", "en", "s", 1),
        (8, "日本語 emoji 🙂 <|endoftext|> ½ ſ   end", "xx", "s", 1),
        (9, "x" * 5000, "en", "s", 5000),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("score", "fp", "id", "body", "digest", "n_tokens", "held_out", "spans"):
        frame = frame.selectExpr("*", f"'clash' AS {name}")
    return frame


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    """Only a null text."""
    return spark.createDataFrame([(None, None, None, None, None)], SCHEMA)


def pytest_collection_modifyitems(items):
    for item in items:
        item.add_marker(pytest.mark.filterwarnings("ignore"))
