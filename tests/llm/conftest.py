import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, rep string, mean double, __gone int, score string, component_id string"
LONG = "Lorem wordy line number. " * 40_000


def nasty_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows; extra columns whose names operators use."""
    texts = [None, "", "   \n\t ", "one", "two words", "Ünïcode ß 漢字 🙂 é", "a.b!", "x" * 5000, LONG, "same text here again and again, all of it.", "same text here again and again, all of it."]
    rows = [(i, t, ["en", "de", None][i % 3], ["src0", None, "other"][i % 3], None, "k", "r", 1.0, 1, "s", "c") for i, t in enumerate(texts)]
    rows.append((None, "a text without an id, quite short.", "en", "src1", 3, None, None, None, None, None, None))
    return [*rows, rows[9], rows[9]]


@pytest.fixture(scope="session")
def nasty(spark):
    return spark.createDataFrame(nasty_rows(), DOCS).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 1, None), (9, 1, 0), (9, 1, 0), (None, 1, 0), (7, 0, 0), (8, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def real_labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet").cache()
