import pytest

ODD = [
    (1, None), (2, ""), (3, " \n\t \n"), (4, "one"), (5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (6, "ß É 日本語 🙂 İ"),
    (7, "same words " * 3000), (8, "x" * 50_000), (9, "\x00\x01 nul"), (10, "a\r\nb c\u0085d"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in every column, empty, very long and repeated texts, and columns named like results."""
    rows = [(i, t, None, None, n) for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, score double, n_words string, node int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def texts():
    """Some real texts of the given tables."""
    import pyarrow.parquet as pq
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    return [t or "" for t in table.column("text").to_pylist()]
