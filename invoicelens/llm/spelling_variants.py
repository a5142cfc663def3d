"""Words that differ by one letter, found through a reduced alphabet.

Letters are hashed to a few symbols. Two words one edit apart have reduced forms that are equal or one edit apart as well, so
each word sends the one-edit neighbourhood of its reduced form and meets the words whose reduced form is one of these; the
original strings are then compared. Being one edit apart is mutual, so a word sends only the half of its neighbourhood that
is not met from the other side: its own form, all deletions, and replacements by a later symbol. Reduced forms travel as
64-bit polynomial hashes, whose neighbours follow from prefix and suffix sums, so a word of L letters costs L times the number
of symbols, whatever its length. Words of up to ``SHORT`` letters go along with the hashes, longer ones are looked up.

Defined results: a NULL or empty text has no words; a NULL id counts as an empty one in the checksum; repeated rows count
again; no rows give no rows. Only the two named columns are read, so no further column can clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from invoicelens.session import materialise

from .batches import ship_package, slices

MIN_LETTERS, MIN_COUNT, FORM_RATIO = 6, 5, 5
SYMBOLS = 8
#: Words of more letters send a number in place of themselves.
SHORT = 64
_LOWER = {c: c + 32 for c in range(65, 91)}
#: An odd number and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def damaged_word(doc_id, run: str, every: int = 199) -> str:
    """``run`` in lower case (A-Z only), without one letter where the checksum of id and run is a multiple of ``every``."""
    run = run.lower() if run.isascii() else run.translate(_LOWER)
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS,
                min_count: int = MIN_COUNT) -> DataFrame:
    """Rows (word, n): words of at least ``min_letters`` after the damage, met at least ``min_count`` times."""
    wanted = docs.select(docs[id_col], docs[text_col])
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % min_letters).findall
    arrow = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            for piece in slices(batch, text_col):
                counts: Counter = Counter()
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    for found, n in Counter(runs(text or "")).items():
                        counts[damaged_word(doc_id, found)] += n
                rows = [(w, n) for w, n in counts.items() if len(w) >= min_letters]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], schema=arrow)

    ship_package(docs.sparkSession)
    return wanted.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def reduced(words: list[str], symbols: int) -> np.ndarray:
    """Words of one length as rows of symbols 1 to ``symbols``."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1).astype(np.uint64)
    return ((points * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) >> np.uint64(16)) % np.uint64(symbols) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, np.uint64(_BASE))
    out[:1] = 1
    return np.multiply.accumulate(out)


def own_keys(rows: np.ndarray) -> np.ndarray:
    return (rows * _powers(rows.shape[1])).sum(axis=1, dtype=np.uint64)


def neighbour_keys(rows: np.ndarray, symbols: int) -> np.ndarray:
    """Keys of each row's reduced form (first), its deletions and its replacements by a later symbol, side by side.

    In place of replacements by an equal or earlier symbol stands the form itself once more.
    """
    count, n = rows.shape
    power = _powers(n)
    terms = rows * power
    before = np.zeros((count, n + 1), np.uint64)
    np.cumsum(terms, axis=1, dtype=np.uint64, out=before[:, 1:])
    whole = before[:, -1:]
    after = whole - before
    out = [whole, before[:, :-1] + after[:, 1:] * np.uint64(_INVERSE)]
    for symbol in range(2, symbols + 1):
        out.append(np.where(rows < symbol, whole - terms + np.uint64(symbol) * power, whole))
    return np.concatenate(out, axis=1)


def _keys(words: DataFrame, symbols: int, neighbours: bool, carried: list[str]) -> DataFrame:
    """The columns ``carried`` of ``words`` by the key of the word's reduced form, or by those of its neighbourhood.

    ``own`` tells the key of the reduced form itself from the others.
    """
    types = dict(words.dtypes)
    schema = f"key bigint, own boolean, {', '.join(f'{c} {types[c]}' for c in carried)}"
    letters = (1 << 21) // (symbols + 2)

    def run(batches):
        for batch in batches:
            sizes = pc.utf8_length(batch.column("word")).to_numpy()
            order = np.argsort(sizes, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(sizes[order]) > 0])
            for start, end in zip(starts, [*starts[1:], len(order)]):
                step = max(1, letters // int(sizes[order[start]]))
                for at in range(start, end, step):
                    some = pa.array(order[at:min(at + step, end)])
                    part = batch.take(some)
                    rows = reduced(part.column("word").to_pylist(), symbols)
                    keys = neighbour_keys(rows, symbols) if neighbours else own_keys(rows)[:, None]
                    own = keys[:, :1].copy()
                    keys.sort(axis=1)
                    new = np.ones(keys.shape, bool)
                    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    which = pa.array(np.repeat(np.arange(len(rows)), new.sum(axis=1)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[new].view(np.int64)), pa.array((keys == own)[new]), *part.select(carried).take(which).columns],
                        names=["key", "own", *carried])

    return words.mapInArrow(run, schema)


def _met(words: DataFrame, symbols: int) -> DataFrame:
    """Pairs of rows of ``words`` whose reduced forms are equal or one edit apart, each pair once: columns a_* and b_*."""
    sides = {}
    for side in ("a", "b"):
        keyed = _keys(words, symbols, side == "a", words.columns)
        sides[side] = keyed.select("key", "own", *[F.col(c).alias(f"{side}_{c}") for c in words.columns])
    order = F.struct(*[f"a_{c}" for c in words.columns]) < F.struct(*[f"b_{c}" for c in words.columns])
    return sides["a"].join(sides["b"].drop("own"), "key").filter(~F.col("own") | order).drop("key", "own")


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """Rows (word, near, near_n): every word of ``words`` (word, n) with each word exactly one edit away, both ways."""
    ship_package(words.sparkSession)
    apart = F.levenshtein("a_word", "b_word", 1) == 1
    size = F.length("word")
    short = _met(words.filter(size <= SHORT), symbols).filter(apart)
    long = words.filter(size >= SHORT).withColumn("id", F.xxhash64("word"))
    keyed = _met_long(long, symbols).filter(apart & (F.greatest(F.length("a_word"), F.length("b_word")) > SHORT))
    pairs = short.select("a_word", "a_n", "b_word", "b_n").unionByName(keyed.select("a_word", "a_n", "b_word", "b_n"))
    ways = F.array(F.struct(F.col("a_word").alias("word"), F.col("b_word").alias("near"), F.col("b_n").alias("near_n")),
                   F.struct(F.col("b_word").alias("word"), F.col("a_word").alias("near"), F.col("a_n").alias("near_n")))
    return pairs.select(F.inline(ways))


def _met_long(words: DataFrame, symbols: int) -> DataFrame:
    """As ``_met`` for words (word, n, id), which travel as their numbers."""
    def keyed(side: str) -> DataFrame:
        return _keys(words.select("word", "id"), symbols, side == "a", ["id"]).select("key", "own", F.col("id").alias(f"{side}_id"))

    met = keyed("a").join(keyed("b").drop("own"), "key").filter(~F.col("own") | (F.col("a_id") < F.col("b_id"))).drop("key", "own")
    for side in ("a", "b"):
        met = met.join(words.select(*[F.col(c).alias(f"{side}_{c}") for c in words.columns]), f"{side}_id")
    return met


def follow(forms: DataFrame) -> DataFrame:
    """Rows (word, root): the end of each word's chain of forms, for rows (word, form). A form counts more than its word does,
    FORM_RATIO times at least, so chains are short and never circular; each round doubles the steps taken."""
    current = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if current.join(onward.select("root"), "root", "left_semi").isEmpty():
            return current
        current = materialise(current.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")))


def group_variants(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) for the words and counts of ``words`` (word, n)."""
    words = materialise(words)
    near = near_words(words, symbols).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    chosen = F.col("best.less") * -1
    is_form = chosen >= FORM_RATIO * F.col("n")
    found = materialise(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, chosen).alias("form_n")))
    roots = follow(found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
