import pytest

LONG = "The long text of one word after another, number {0}. "


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, and columns named like results."""
    long = "".join(LONG.format(k) for k in range(6000))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "b", 0), (3, " \n\t ", None, "b", 4), (None, "a text without an id of its own", "en", None, 31),
        (5, "one and the same short text", "en", "a", 27), (5, "one and the same short text", "en", "a", 27), (6, long, "en", "c", len(long)), (7, "word", "fr", "c", 4),
        (8, "one and the same short text", "de", None, 27),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("n_words", "kept", "size", "taken", "pii", "secrets", "p_toxic", "n_hit", "n", "d1", "node", "component_id", "chunk", "score", "host", "items"):
        docs = docs.withColumn(name, docs["doc_id"].cast("string"))
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")
