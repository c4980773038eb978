import pytest
from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text) or whole rows, dealt over partitions."""
    def make(rows, partitions=3):
        full = [r if len(r) == 5 else (*r, "en", f"s{i % 3}", len(r[1] or ""))
                for i, r in enumerate(rows)]
        schema = T.StructType.fromDDL(DOCUMENTS)
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long_text = "the quick brown fox and some more words " * 20_000
    return documents([
        (1, "one two three four five"), (1, "one two three four five"), (2, ""), (3, None),
        (None, "a row without an id"), (4, "   \n\t "), (5, long_text), (6, "é 日本 😀 ß"),
        (7, "x", None, None, None), (None, None, None, None, None), (8, "one two three four five"),
    ])
