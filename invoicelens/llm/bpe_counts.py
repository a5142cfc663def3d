"""Token counts by heap-and-linked-list byte-pair merging; no identifier is ever emitted.

The pieces of a text are its added tokens (one token each) and, between them, the matches of the byte-level pattern. A piece
starts as one symbol per byte; the lowest-ranked adjacent pair is merged again and again, the leftmost of equals first, and
its count is the number of initial symbols less the number of merges.

Cases: NULL and empty texts have no tokens; repeated rows and ties need no care; an empty table gives an empty table. A
piece of any length is merged whole, in n log n steps.
"""

from __future__ import annotations

import json
import uuid
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame

from .batches import map_texts
from .bounded import Memo, held
from .pieces import Pieces

MEMO_PIECES = 400_000
LIMIT = 512
NONE = 0xFFFFF  # stands where a symbol was merged away and behind the last one


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, and their bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceCounter:
    """Counts the tokens of a piece by the merges of a vocabulary file."""

    def __init__(self, merges: list[tuple[str, str]], vocabulary: dict[str, int]):
        self._symbol_of_byte = {b: vocabulary[c] for c, b in byte_symbols().items()}
        self._merged = {}
        for rank, (a, b) in enumerate(merges):
            self._merged.setdefault(vocabulary[a] << 20 | vocabulary[b], rank << 20 | vocabulary[a + b])

    def count(self, piece: bytes) -> int:
        symbols = [self._symbol_of_byte[b] for b in piece]
        n = len(symbols)
        merged = self._merged.get
        # A heap entry packs a pair's rank and position: equal ranks pop leftmost first. It is stale when the pair changed.
        heap = []
        for i in range(n - 1):
            hit = merged(symbols[i] << 20 | symbols[i + 1])
            if hit is not None:
                heap.append(hit >> 20 << 32 | i)
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols.append(NONE)
        count = n
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            hit = merged(symbols[i] << 20 | symbols[j])
            if hit is None or hit >> 20 != entry >> 32:
                continue
            made = symbols[i] = hit & 0xFFFFF
            symbols[j] = NONE
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                hit = merged(made << 20 | symbols[k])
                if hit is not None:
                    heappush(heap, hit >> 20 << 32 | i)
            h = before[i]
            if h >= 0:
                hit = merged(symbols[h] << 20 | made)
                if hit is not None:
                    heappush(heap, hit >> 20 << 32 | h)
        return count


class TextCounter:
    """Counts whole texts; loaded once per worker from the vocabulary file and the pattern."""

    def __init__(self, vocabulary: bytes, pattern: str):
        spec = json.loads(vocabulary)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        counter = PieceCounter(merges, model["vocab"])
        self._pieces = Pieces(pattern).of
        added = [t["content"] for t in spec.get("added_tokens", ())]
        self._added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self._count = Memo(lambda piece: counter.count(piece.encode()), MEMO_PIECES)

    def count(self, text: str) -> int:
        if self._added is None:
            parts, n = [text], 0
        else:
            parts = self._added.split(text)
            n = len(parts) - 1
        count = self._count
        for part in parts:
            n += sum([count[p] for p in self._pieces(part)])
        return n


def count_tokens(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit). The vocabulary file, of fixed size, is read on the driver and broadcast."""
    with open(vocabulary_path, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    key = uuid.uuid4().hex

    def per_slice(texts: list[str]) -> dict[str, list]:
        counter = held(key, lambda: TextCounter(sent.value, pattern))
        counts = [counter.count(t) for t in texts]
        return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    return map_texts(docs, id_col, text_col, "n_bytes bigint, n_tokens bigint, over_limit boolean", per_slice)
