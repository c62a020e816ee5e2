import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, size long, key long, tie long, first_id long, copies int, rejected boolean, y int"
LONG = "word number " + " ".join(f"w{i % 977}" for i in range(300_000)) + " end"


def rows(pairs):
    """Rows of documents with columns whose names the operators use inside."""
    return [(d, t, None if d is None else "en", s, None, 7, 0.5, 1, 2, 3, 4, 5, True, 1) for d, t, s in pairs]


EDGE = [
    (1, "the same text stands here twice and then it ends", "a"), (1, "the same text stands here twice and then it ends", "a"),
    (2, "the same text stands here twice and then it ends", "b"), (3, None, None), (4, "", "a"), (5, " \t\n", ""), (None, "text without an id", "c"),
    (None, None, None), (6, LONG, "a"), (7, "x", "b"), (7, "y z", "b"), (8, "İstanbul ſ ñ é \x1c\x00 end.", "é"), (-9223372036854775808, "least id", "c"),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows(EDGE), COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (3, None, None), (None, 1, 1), (4, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
