"""Benchmark decontamination by Wu-Manber search for many patterns at once.

The alphabet are words: texts are cut into words and patterns are windows of 10 consecutive words of a benchmark item (an
item of fewer words is one shorter window). For patterns of one length the block shift table says, for the last ``BLOCK``
words under the window's end, how far the window can move without passing an occurrence; where it can't move, the block
selects the bucket of patterns with that suffix, and comparing word by word confirms. Patterns of different lengths are
separate sets, so that a short item never shortens the shifts of the others.

The patterns are broadcast in parts of at most ``part_bytes`` of item text; the size is measured first. With several parts,
the texts pass each part in turn and the hits found so far are written to the shared folder between passes.

Cases: NULL and empty texts and items have no words and hit nothing; repeated rows are searched each; items with equal
windows are all reported; empty tables give an empty table, or no hits.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from invoicelens.session import materialise

from .batches import keep_texts, ship_package, slices
from .bounded import held

WINDOW = 10
BLOCK = 2
PART_BYTES = 16 << 20

# Fixed values of the contract: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
_WORD_BYTES = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]


class PatternSet:
    """Patterns of one length: shift table by block, buckets by suffix block."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list]):
        self.length, self.block, self.owners = length, min(BLOCK, length), patterns
        self.most = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = defaultdict(list)
        for pattern in patterns:
            for end in range(self.block, length + 1):
                block = pattern[end - self.block:end]
                self.shift[block] = min(self.shift.get(block, self.most), length - end)
            self.bucket[pattern[length - self.block:]].append(pattern)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """(start, owners) of each occurrence."""
        length, most, n = self.length, self.most, len(words)
        end, shift = length, self.shift.get
        if self.block == 2:
            while end <= n:
                move = shift((words[end - 2], words[end - 1]), most)
                if move:
                    end += move
                    continue
                yield from self._confirm(words, end - length)
                end += 1
        else:
            for end in range(length, n + 1):
                if not shift((words[end - 1],), most):
                    yield from self._confirm(words, end - length)

    def _confirm(self, words: list[bytes], start: int) -> Iterator[tuple[int, list]]:
        end = start + self.length
        for pattern in self.bucket[tuple(words[end - self.block:end])]:
            if words[start] == pattern[0] and tuple(words[start:end]) == pattern:
                yield start, self.owners[pattern]


class Searcher:
    """All windows of some benchmark items."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        by_length: dict[int, dict[tuple[bytes, ...], list]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            for pattern in dict.fromkeys(windows_of(words_of(text), window)):
                by_length[len(pattern)][pattern].append(item)
        self._sets = [PatternSet(n, dict(patterns)) for n, patterns in sorted(by_length.items())]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of hit words (end exclusive), and the items that occur."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        for patterns in self._sets:
            for start, owners in patterns.search(words):
                spans.append((start, start + patterns.length))
                items.update(owners)
        return merge_spans(spans), items

    def occurs_in(self, words: list[bytes]) -> bool:
        return any(True for patterns in self._sets for _ in patterns.search(words))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(end, merged[-1][1])
        else:
            merged.append((start, end))
    return merged


def _parts(items: DataFrame, item_col: str, text_col: str, part_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """The items with text in parts of about ``part_bytes``; one part is on the driver at a time."""
    given = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter(F.col("text") != "")
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // part_bytes)
    for part in range(n):
        own = given if n == 1 else given.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == part)
        yield [(row["item"], row["text"]) for row in own.toLocalIterator()]


def search_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                     part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (id, n_words, spans, items): per document the hit word spans and the distinct items with an occurring window."""
    item_type = items.schema[item_col].dataType.simpleString()
    found = None
    parts = _one_at_least(_parts(items, item_col, item_text_col, part_bytes))
    for part in parts:
        if found is None:
            current = docs.select(docs[id_col], docs[text_col].alias("text"),
                                  F.lit(0).cast("bigint").alias("n_words"),
                                  F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
                                  F.array().cast(f"array<{item_type}>").alias("items"))
        else:
            current = materialise(found)
        found = _pass(current, part, window)
    return found.drop("text")


def _one_at_least(parts: Iterator[list]) -> Iterator[list]:
    """The parts, or one empty part where there are none."""
    some = False
    for part in parts:
        some = True
        yield part
    if not some:
        yield []


def _pass(current: DataFrame, part: list[tuple[object, str]], window: int) -> DataFrame:
    sent, key = current.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex
    schema: StructType = current.schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = held(key, lambda: Searcher(sent.value, window))
        for batch in batches:
            for piece in slices(batch, "text"):
                counts, spans, items = [], [], []
                for row in piece.select(["text", "spans", "items"]).to_pylist():
                    words = words_of(row["text"] or "")
                    hit, owners = searcher.hits(words)
                    if row["spans"]:
                        hit = merge_spans(hit + [(s["start"], s["end"]) for s in row["spans"]])
                    counts.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in hit])
                    items.append(sorted(owners.union(row["items"]), key=lambda i: (i is None, str(i))))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), *[pa.array(c, type=f.type) for c, f in zip((counts, spans, items), list(arrow)[2:])]],
                    schema=arrow)

    ship_package(current.sparkSession)
    return current.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The counts and the hash of the items for rows of ``search_documents``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(found.columns[0], "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents in which no window occurs, all columns as they are."""
    kept = docs
    for n, part in enumerate(_parts(items, item_col, item_text_col, part_bytes)):
        kept = _drop(materialise(kept) if n else kept, text_col, part, window)
    return kept


def _drop(docs: DataFrame, text_col: str, part: list[tuple[object, str]], window: int) -> DataFrame:
    sent, key = docs.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex

    def clean(texts: list[str]) -> list[bool]:
        searcher = held(key, lambda: Searcher(sent.value, window))
        return [not searcher.occurs_in(words_of(t)) for t in texts]

    return keep_texts(docs, text_col, clean)
