"""Arrow batches of texts, cut into slices of bounded size."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE_BYTES = 4 << 20
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Lets the executors import this package, by sending it along once per application where PYTHONPATH doesn't have it."""
    root = Path(__file__).resolve().parents[2]
    application = spark.sparkContext.applicationId
    if application in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _SHIPPED.add(application)
    archive = Path(tempfile.mkdtemp(prefix="invoicelens-")) / "invoicelens.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for file in sorted((root / "invoicelens").rglob("*.py")):
            packed.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of ``batch`` whose texts hold about ``limit`` bytes; a longer text is a piece of its own."""
    texts = batch.column(column)
    if texts.nbytes <= limit:
        if batch.num_rows:
            yield batch
        return
    lengths = [n or 0 for n in pc.binary_length(texts).to_pylist()]
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def map_texts(docs: DataFrame, id_col: str, text_col: str, fields: str,
              per_slice: Callable[..., dict[str, list]], with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id and what ``per_slice`` makes of its text.

    ``per_slice`` gets the texts of a slice (NULL as empty) and returns equally long columns named as in ``fields``;
    ``with_ids`` gives it the ids as well. Only the id and the text are read, so no other column can clash with the results.
    """
    wanted = docs.select(docs[id_col], docs[text_col])
    schema = StructType([wanted.schema[0], *StructType.fromDDL(fields).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text_col):
                texts = [t or "" for t in piece.column(1).to_pylist()]
                made = per_slice(texts, piece.column(0).to_pylist()) if with_ids else per_slice(texts)
                columns = [piece.column(0), *[made[f.name] for f in schema.fields[1:]]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c.cast(f.type)
                     for c, f in zip(columns, arrow)], schema=arrow)

    ship_package(docs.sparkSession)
    return wanted.mapInArrow(run, schema)


def keep_texts(docs: DataFrame, text_col: str, keep: Callable[[list[str]], list[bool]]) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text ``keep`` wants (NULL as empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for piece in slices(batch, text_col):
                yield piece.filter(pa.array(keep([t or "" for t in piece.column(at).to_pylist()]), type=pa.bool_()))

    ship_package(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
