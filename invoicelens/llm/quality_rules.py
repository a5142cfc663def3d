"""Quality rules as a short-circuit cascade.

Each rule rejects a text or lets it pass; a text is kept when no rule rejects it. Before the run, every rule's cost and
rejection share are measured on a bounded sample, and rules are then asked in order of rejections per cost, the base rule
of the contract among them. The order changes the work only, never a verdict.

Cases: a NULL or empty text has no words and is rejected; repeated rows get the same verdict; an empty table gives an empty
table; ties in the order go to the rule listed first. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import time
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import keep_texts, map_texts, ship_package, slices

# Fixed values of the contract.
WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30



class Measured:
    """A text whose measures are computed when a rule first asks for them."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, WHITE)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line.translate(None, WHITE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def n_marks(self) -> int:
        return self.raw.count(b"!!")

    @cached_property
    def n_stutters(self) -> int:
        return sum(map(bytes.__eq__, self.words, self.words[1:]))

    @cached_property
    def n_upper(self) -> int:
        return sum(map(capital, self.words))


def capital(word: bytes) -> bool:
    """Whether a word has an upper-case letter and no lower-case one, by Unicode's general categories."""
    if word.isascii():
        return word.isupper()
    kinds = set(map(unicodedata.category, word.decode("utf-8", "surrogatepass")))
    return "Lu" in kinds and "Ll" not in kinds


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words which the text has twice or more.

    Exact: windows are numbered by doubling, from the numbers of their halves, so equal numbers mean equal words.
    """
    if len(words) <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    span = 1
    while span < window:
        pairs = ids[:-span] * (len(words) + 1) + ids[span:]
        kinds, ids = np.unique(pairs, return_inverse=True)
        span *= 2
        if len(kinds) == len(pairs):
            return 0
    again = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:len(again)] += again
    edges[window:window + len(again)] -= again
    return int((np.cumsum(edges[:-1]) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measured], bool]


BASE_RULES = (
    Rule("few_words", lambda m: m.n_words < LEAST_WORDS),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > MOST_REPEATED * m.n_words),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("exclamations", lambda m: 10 * m.n_marks > m.n_words),
    Rule("capitals", lambda m: 2 * m.n_upper > m.n_words),
    Rule("stutters", lambda m: 10 * m.n_stutters > 3 * m.n_words),
    Rule("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 100 * m.n_words),
    Rule("repeated_lines", lambda m: len(m.lines) >= 4 and 2 * m.n_dup_lines > len(m.lines)),
)


def profile(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> DataFrame:
    """Rows (rule, seconds, asked, rejected) of each rule on at most ``sample_rows`` texts, measured inside tasks."""
    sample = docs.select(F.col(text_col).alias("text")).limit(sample_rows)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                rows = []
                texts = [t or "" for t in piece.column(0).to_pylist()]
                for k, rule in enumerate(rules):
                    fresh = [Measured(t) for t in texts]
                    began = time.perf_counter()
                    rejected = sum(bool(rule.rejects(m)) for m in fresh)
                    rows.append({"rule": k, "seconds": time.perf_counter() - began, "asked": len(fresh), "rejected": rejected})
                yield pa.RecordBatch.from_pylist(rows, pa.schema(
                    [("rule", pa.int32()), ("seconds", pa.float64()), ("asked", pa.int64()), ("rejected", pa.int64())]))

    ship_package(docs.sparkSession)
    measured = sample.mapInArrow(run, "rule int, seconds double, asked bigint, rejected bigint")
    return measured.groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("asked").alias("asked"),
                                        F.sum("rejected").alias("rejected"))


def ordered(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> tuple[Rule, ...]:
    """The rules by rejections per second on the sample, best first; one row per rule comes to the driver."""
    gain = {r["rule"]: (r["rejected"] + 1) / (r["asked"] + 2) / (r["seconds"] / r["asked"] + 1e-9)
            for r in profile(docs, text_col, rules, sample_rows).collect() if r["asked"]}
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: (-gain.get(k, 0.0), k)))


def passes(measured: Measured, cascade: tuple[Rule, ...]) -> bool:
    return not any(rule.rejects(measured) for rule in cascade)


def filter_documents(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> DataFrame:
    """The documents that every rule lets pass, all columns as they are."""
    cascade = ordered(docs, text_col, rules, sample_rows)
    return keep_texts(docs, text_col, lambda texts: [passes(Measured(t), cascade) for t in texts])


def measure_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES,
                      sample_rows: int = 1000) -> DataFrame:
    """The base measures and the verdict of each document."""
    cascade = ordered(docs, text_col, rules, sample_rows)

    def per_slice(texts: list[str]) -> dict[str, list]:
        all_measured = [Measured(t) for t in texts]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        made = {n: [getattr(m, n) for m in all_measured] for n in names}
        made["base_failed"] = [any(r.rejects(m) for r in BASE_RULES) for m in all_measured]
        made["kept"] = [passes(m, cascade) and not failed for m, failed in zip(all_measured, made["base_failed"])]
        return made

    return map_texts(docs, id_col, text_col,
                     "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
                     "base_failed boolean, kept boolean", per_slice)
