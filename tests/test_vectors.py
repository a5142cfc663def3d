import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from invoicelens.operators import vectors
from invoicelens.sources import samples, vector_store

SF = "/root/testdata/sf0.001"


def split(text, **options):
    """The function inside the UDF, called on one text."""
    import pandas as pd
    batches = vectors.chunk_texts(**options).func(iter([pd.Series([text])]))
    return next(batches)[0]


def check(text, pieces, size, overlap):
    """Pieces fit, follow each other, overlap no more than allowed and leave out white space only."""
    end = at = 0
    for piece in pieces:
        assert 0 < len(piece) <= size
        at = text.find(piece, max(0, end - overlap, end - len(piece) + 1))
        assert at >= 0 and text[end:at].strip() == ""
        assert at + len(piece) > end
        end = at + len(piece)
    assert text[end:].strip() == ""


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ab", "palabra", " ", "\n", "\n\n", "x" * 40, "ñ"]), max_size=60).map("".join))
def test_chunks_cover_the_text(spark, shape):
    # Every letter differs, so that a piece is found in one place only.
    text = "".join(c if c.isspace() else chr(0x4E00 + i) for i, c in enumerate(shape))
    check(text, split(text, max_size=25, overlap=6), 25, 6)


def test_separator_preference(spark):
    assert split("uno dos\n\ntres cuatro\ncinco", max_size=20, overlap=0) == ["uno dos", "tres cuatro\ncinco"]
    assert split("uno dos tres", max_size=8, overlap=4) == ["uno dos", "dos tres"]
    assert split("abcdefghij", max_size=4, overlap=1) == ["abcd", "defg", "ghij"]
    assert split("", max_size=4, overlap=1) == [] and split(None) == []


def test_whole_documents_are_chunked(spark):
    documents = samples.table(spark, SF, "documents")
    texts = {str(r["doc_id"]): r["text"] for r in documents.collect()}
    by_source = {}
    for r in vectors.chunk_documents(documents, "doc_id").orderBy("source", "chunkIndex").collect():
        by_source.setdefault(r["source"], []).append(r["text"])
    assert set(by_source) == {k for k, t in texts.items() if t.strip()}
    for source, pieces in by_source.items():
        check(texts[source], pieces, 512, 50)


def test_empty_text_is_an_error_when_asked(spark):
    documents = spark.createDataFrame([(1, "\u0000 ")], "doc_id int, text string")
    assert vectors.chunk_documents(documents, "doc_id").count() == 0
    with pytest.raises(Exception, match="no text could be extracted"):
        vectors.require_text(documents).collect()


def test_pairs_and_search_equal_brute_force(spark, driver_entry):
    found = driver_entry.queries()["a8_busqueda_semantica"](spark, SF).collect()
    pairs = driver_entry._paired(spark, SF).collect()
    query = np.array(driver_entry._first_vector(spark, SF), dtype=float)

    def score(vector):
        v = np.array(vector, dtype=float)
        return float(v @ query / np.sqrt(v @ v) / np.sqrt(query @ query))

    ranked = sorted(((-score(p["vector"]), p["metadata"]["source"], p["metadata"]["chunkIndex"]) for p in pairs))[:10]
    assert [(r["source"], r["chunkIndex"]) for r in found] == [(s, i) for _, s, i in ranked]
    assert [r["score"] for r in found] == pytest.approx([-s for s, _, _ in ranked], abs=1e-6)


def test_zero_and_missing_vectors_are_left_out(spark):
    stored = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 1.0]), (4, None)],
                                   "id int, embedding array<float>")
    assert [r["id"] for r in vectors.nearest(stored, [2.0, 0.0], ["id"], 5).collect()] == [2, 3]
    assert vectors.nearest(stored, [0.0, 0.0], ["id"], 5).count() == 0


def test_another_dimension_is_an_error(spark):
    stored = spark.createDataFrame([(1, [1.0, 0.0])], "id int, embedding array<float>")
    with pytest.raises(Exception):
        vectors.nearest(stored, [1.0, 0.0, 0.0], ["id"]).collect()


def test_upsert_replaces_equal_keys(spark, tmp_path):
    def stored(*rows):
        frame = spark.createDataFrame(list(rows), "source string, chunkIndex int, text string, v array<float>")
        return frame.select(F.col("v").alias("vector"), F.struct("text", "source", "chunkIndex").alias("metadata"))

    old = stored(("a", 0, "x", [1.0]), ("a", 1, "y", [2.0]))
    merged = vector_store.upsert_vectors(old, stored(("a", 1, "z", [3.0]), ("b", 0, "w", [4.0])))
    vector_store.write_vectors(merged, str(tmp_path / "v"))
    got = sorted((r["metadata"]["source"], r["metadata"]["chunkIndex"], r["metadata"]["text"])
                 for r in vector_store.read_vectors(spark, str(tmp_path / "v")).collect())
    assert got == [("a", 0, "x"), ("a", 1, "z"), ("b", 0, "w")]


def test_a_chunk_without_a_vector_stays(spark):
    chunks = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "source string, chunkIndex int, text string")
    stored = spark.createDataFrame([("a", 1, [1.0])], "source string, chunkIndex int, embedding array<float>")
    paired = vectors.pair_with_vectors(chunks, stored)
    assert paired.count() == 2
    assert [tuple(r) for r in vectors.without_vector(paired).collect()] == [("x", "a", 0)]


def test_chunks_are_registered_with_their_whole_vectors(spark, driver_entry):
    frame = driver_entry.queries()["v4_fragmentos_con_vector"](spark, "/root/testdata/sf0.001")
    assert {f"v{i}" for i in range(1, 65)} < set(frame.columns)
