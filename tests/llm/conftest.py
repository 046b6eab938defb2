import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and very long texts, ties and repeated rows.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog\nshared line of text\n\nend", "en", "a", 10),
    (2, "Shared Line of Text  \nother words stand here\nSHARED line of text\t", "en", "a", 10),
    (3, None, "en", "b", None),
    (4, "", None, None, 0),
    (5, "x", "de", "c", 1),
    (5, "x", "de", "c", 1),
    (6, "wort " * 20_000, "de", None, 100_000),
    (7, "É ist groß und die Straße ist naß\nshared line of text", "de", "c", 3),
    (None, "no number here but words that go on for a while", "en", "b", 5),
    (8, "The quick brown fox jumps over the lazy dog\nshared line of text\n\nend", "en", "d", 10),
    (9, "a" * 50_000, "en", "d", 50_000),
    (10, " \t\n\x0b\x0c\r ", "en", "d", 5),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The same rows with columns named like those the operators add."""
    from pyspark.sql import functions as F

    for name in ("size", "shard", "slot", "key", "node", "label", "words", "row", "target", "taken", "start", "unit", "cell", "id", "score", "n", "k", "th", "__id", "__th", "__n", "__k", "total", "group", "rank"):
        odd_docs = odd_docs.withColumn(name, F.lit("extra"))
    return odd_docs
