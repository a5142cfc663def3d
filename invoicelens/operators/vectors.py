"""Document chunks and cosine search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from invoicelens.functions.text import without_nul

# Default chunk size, overlap, and the separators tried in turn.
CHUNK_SIZE, CHUNK_OVERLAP = 512, 50
SEPARATORS = ("\n\n", "\n", " ")


def chunk_texts(max_size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: Sequence[str] = SEPARATORS):
    """A pandas UDF from text to its chunks.

    Each chunk ends at the last paragraph break that fits, else line break, else space, else at
    the size limit. The next one starts up to ``overlap`` characters earlier, at a word start.
    """
    if not 0 <= overlap < max_size:
        raise ValueError("overlap must be smaller than max_size")
    separators = tuple(separators)

    def end_of_chunk(text: str, start: int, floor: int) -> tuple[int, bool]:
        """End of the chunk that begins at ``start``, and whether it had to cut a word."""
        limit = start + max_size
        if limit >= len(text):
            return len(text), False
        for separator in separators:
            at = text.rfind(separator, floor, limit)
            if at >= floor:
                return at + len(separator), False
        return limit, True

    def split(text: str | None) -> list[str]:
        pieces, start, end = [], 0, 0
        text = text or ""
        while end < len(text):
            # A chunk goes beyond the end of the one before, and by more than white space.
            known = end
            end, cut = end_of_chunk(text, start, known + 1)
            if text[known:end].strip():
                pieces.append(text[start:end].strip())
            back = max(start + 1, end - overlap)
            space = text.find(" ", back - 1, end - 1)
            start = space + 1 if space >= 0 else back if cut else end
        return pieces

    @F.pandas_udf("array<string>")
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(split)

    return chunks


def chunk_documents(documents: DataFrame, source: str = "source", text: str = "text",
                    max_size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(source, chunkIndex, text) of every document. A document without text has no chunk."""
    split = chunk_texts(max_size, overlap)
    cleaned = documents.select(F.col(source).cast("string").alias("source"), without_nul(F.col(text)).alias("text"))
    filled = cleaned.filter(F.length(F.trim("text")) > 0)
    return filled.select("source", F.posexplode(split("text")).alias("chunkIndex", "text"))


def require_text(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents, with an error when one has no text."""
    empty = F.coalesce(F.length(F.trim(without_nul(F.col(text)))), F.lit(0)) == 0
    checked = F.when(empty, F.raise_error(F.lit("no text could be extracted"))).otherwise(F.col(text))
    return documents.withColumn(text, checked)


def pair_with_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """{vector, metadata} of each chunk; ``vectors`` has source, chunkIndex and embedding.

    A chunk without a vector stays, with a NULL vector; ``without_vector`` lists those.
    """
    joined = chunks.join(vectors, ["source", "chunkIndex"], "left")
    return joined.select(F.col("embedding").alias("vector"), F.struct("text", "source", "chunkIndex").alias("metadata"))


def without_vector(paired: DataFrame) -> DataFrame:
    """The chunks of ``pair_with_vectors`` that have no vector yet."""
    return paired.filter(F.col("vector").isNull()).select("metadata.*")


def cosine_to(query: Sequence[float], rows_at_once: int = 1024):
    """A pandas UDF from stored vectors to their cosine similarity to ``query``.

    NULL for a missing vector and for one of all zeros; another dimension is an error. Arrow
    batches go through one matrix product each: on wide vectors this is several times faster
    than array functions, which run element by element.
    """
    wanted = np.asarray(query, dtype=np.float64)
    length = float(np.sqrt(wanted @ wanted))

    @F.pandas_udf("double")
    def similarity(vectors: pd.Series) -> pd.Series:
        scores = np.full(len(vectors), np.nan)
        present = np.flatnonzero(vectors.notna().to_numpy())
        for at in range(0, len(present), rows_at_once):
            some = present[at:at + rows_at_once]
            matrix = np.stack(vectors.iloc[some].to_numpy()).astype(np.float64)
            lengths = np.sqrt((matrix * matrix).sum(axis=1)) * length
            scores[some] = np.divide(matrix @ wanted, lengths, out=np.full(len(some), np.nan), where=lengths > 0)
        return pd.Series(scores)

    return similarity


def nearest(vectors: DataFrame, query: Sequence[float], keys: Sequence[str], top_k: int = 10,
            embedding: str = "embedding") -> DataFrame:
    """The ``top_k`` rows closest to one query vector; every task keeps only its own best."""
    scored = vectors.withColumn("score", cosine_to(query)(F.col(embedding))).filter(F.col("score").isNotNull())
    return scored.drop(embedding).orderBy(F.col("score").desc(), *keys).limit(top_k)


def vector_query(store: DataFrame, query: Sequence[float], top_k: int = 10) -> DataFrame:
    """The search tool: metadata and score of the closest stored chunks."""
    flat = store.select("metadata.*", F.col("vector").alias("embedding"))
    return nearest(flat, query, ["source", "chunkIndex"], top_k)
