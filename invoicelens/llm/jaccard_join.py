"""N-gram Jaccard join by universe partition and pigeonhole, exact, with connected groups.

A text is the set of its distinct shingles (5 words), as 64-bit hashes. Two sets link when their Jaccard similarity reaches
``percent``. Sets of sizes r and s that link differ in at most ``H = (r + s) (1 - t) / (1 + t)`` elements.

**Signatures.** Sizes fall into bands. In a band the universe of shingles is hashed into m segments, and each segment is
indexed as it is (covers 1 difference) or with its one-deletion neighbourhood as well (covers 2). Where what is covered
exceeds the band's H, two linked sets share a signature of some segment. How many segments get neighbourhoods is allocated
per band by cost: signatures written against candidates expected from segments of that many shingles. A set indexes itself
in its own band and, when a linked smaller set may lie in the band below, in that one too.

Empty segments are shared by everything and are not indexed; bands cover a few segments more to make up for it. A set with
more empty segments than that is indexed by its empty segments too: a link needs those only if both sets are such.

**Candidates.** In a bucket of one signature every set is compared with the bucket's smallest id only. If members are then
still in different components, those of different components are compared as well, so no link is lost and a group of copies
costs about one comparison per member. Buckets that a sample shows to be very large never meet in one task: their smallest id
is found by partial aggregation and sent to the rows. Equal sets are found by their hash and indexed about once per slice of a batch.

Pairs that share too few signatures for their sizes, or whose parities differ in too many places, are left out before sets
are compared.

**Verification** is on the whole sets, made anew for the candidates only.

Ids name documents: rows that share an id are the same document given again.

Cases: NULL and empty texts have the empty set and link with nothing; texts under 5 words are one shingle; repeated rows
link as equal sets; a row without id takes part by an equal set only, and else has component NULL; an empty table gives an
empty table. Two shingles with one hash would count as equal (about one pair in 10^19).
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from invoicelens.session import discard, materialise

from .batches import map_texts
from .bounded import Memo, held
from .buckets import SAMPLE, ascending, broadcast_if_small, parities, places_apart, resolve, shared_buckets

SHINGLE = 5
PERCENT = 80
GROWTH = 1.35  # of the sizes of a band
PARITY_WORDS = 8  # of 64 bits
SHARED = 0.002  # chance that two unlike sets share a given element, for the cost of candidates

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_K = np.uint64(0x9E3779B97F4A7C15)
_WORD_HASHES = Memo(xxhash.xxh3_64_intdigest, 300_000)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.array([_WORD_HASHES[w] for w in words], np.uint64)
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        total = total * _K + hashes[k:len(words) - width + 1 + k]
    return ascending(np.sort(mix(total)))


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int  # inclusive
    exact: int  # segments indexed as they are
    near: int  # segments indexed with their one-deletion neighbourhoods
    spare: int  # coverage that empty segments may take away

    @property
    def segments(self) -> int:
        return self.exact + self.near


def plan_band(number: int, low: int, high: int, n_docs: int, percent: int = PERCENT) -> Band:
    """The cheapest allocation that covers the band's largest difference."""
    most = (high + high * 100 // percent) * (100 - percent) // (100 + percent)
    if most == 0:
        return Band(number, low, high, 0, 0, 0)  # equal sets only
    best = None
    for near in range(0, most // 2 + 2):
        spare = 0
        for _ in range(60):
            exact = max(0, most + 1 + spare - 2 * near)
            m = exact + near
            empty = (1 - 1 / m) ** low
            single = low / m * (1 - 1 / m) ** (low - 1)
            lost = (exact + 2 * near) * empty + near * single
            want = math.ceil(lost + 5 * math.sqrt(lost)) if lost > 1e-7 else 0
            if want <= spare or spare > 2 * most + 4:
                break
            spare = max(spare + 1, min(want, spare + 1 + most // 8))
        each = (low + high) / 2 / m
        cost = exact + near * (1 + each) + n_docs * m * SHARED ** each
        if best is None or cost < best[0]:
            best = cost, Band(number, low, high, exact, near, spare)
        if near > 8 and cost > 4 * best[0]:
            break
    return best[1]


class Bands:
    """Bands of growing sizes, planned when first asked for."""

    def __init__(self, n_docs: int, percent: int = PERCENT):
        self.percent, self._n_docs, self._bands = percent, n_docs, []

    def of(self, size: int) -> list[Band]:
        """The band of a size and, when a set that links with one of that size may be in it, the one below."""
        while not self._bands or self._bands[-1].high < size:
            low = self._bands[-1].high + 1 if self._bands else 1
            high = max(low, int(low * GROWTH))
            self._bands.append(plan_band(len(self._bands), low, high, self._n_docs, self.percent))
        k = next(b.number for b in reversed(self._bands) if b.low <= size)
        own = self._bands[k]
        return [own, self._bands[k - 1]] if k and -(-size * self.percent // 100) < own.low else [own]


def signatures(shingles: np.ndarray, bands: list[Band]) -> tuple[np.ndarray, list[int]]:
    """The signatures of a set in some bands, and per band how many segments can match in coverage that empty ones don't take."""
    made, left = [], []
    for band in bands:
        m = band.segments
        if m == 0:
            left.append(0)
            continue
        segment = (mix(shingles ^ np.uint64(band.number * 2 + 1)) % np.uint64(m)).astype(np.int64)
        value = mix(shingles + _K)
        order = np.argsort(segment, kind="stable")
        segment, value = segment[order], value[order]
        starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        sums, present = np.add.reduceat(value, starts), segment[starts]
        salts = mix(np.arange(m, dtype=np.uint64) + np.uint64(band.number << 32))
        made.append(mix(sums + salts[present]))
        counts = np.diff(np.concatenate([starts, [len(segment)]]))
        near = segment >= band.exact  # the last segments have neighbourhoods
        single = np.repeat(counts, counts) == 1
        some = near & ~single
        made.append(mix(np.repeat(sums, counts)[some] - value[some] + salts[segment[some]]))
        unused = np.ones(m, bool)
        unused[present] = False
        empty = np.flatnonzero(unused)
        alone = segment[near & single]
        lost = len(empty) + int((empty >= band.exact).sum()) + len(alone)
        left.append(m - lost)
        if lost > band.spare:
            made.append(mix(salts[np.concatenate([empty, alone])] ^ _K))
    return (ascending(np.sort(np.concatenate(made))) if made else np.empty(0, np.uint64)), left


def set_hashes(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    raw = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (raw >> 64) - (1 << 63), (raw & ((1 << 64) - 1)) - (1 << 63)


def index_documents(docs: DataFrame, id_col: str, text_col: str, percent: int = PERCENT) -> DataFrame:
    """Rows (id, n_shingles, hi, lo, matching, least, parity, signatures); of equal sets in a slice only the smallest id has signatures.

    ``matching`` counts the segments of the set's own band that would match if nothing differed, ``least`` is the smallest
    such count of its bands. ``parity`` is that of the shingles.
    """
    n_docs = docs.count()
    key = uuid.uuid4().hex

    def per_slice(texts: list[str], ids: list) -> dict[str, list]:
        bands = held(key, lambda: Bands(n_docs, percent))  # what a slice gives depends on the slice alone
        sets = [shingle_set(t) for t in texts]
        hashes = [set_hashes(s) for s in sets]
        first: dict[tuple[int, int], int] = {}
        for at, (own, doc) in enumerate(zip(hashes, ids)):
            if len(sets[at]) and doc is not None and (own not in first or doc < ids[first[own]]):
                first[own] = at
        made: dict[str, list] = {"n_shingles": [len(s) for s in sets], "hi": [h for h, _ in hashes], "lo": [low for _, low in hashes],
                                 "matching": [], "least": [], "parity": [], "signatures": []}
        owner = np.repeat(np.arange(len(sets)), made["n_shingles"])
        made["parity"] = list(parities(np.concatenate([*sets, np.empty(0, np.uint64)]), owner, len(sets), PARITY_WORDS))
        for at, shingles in enumerate(sets):
            in_bands = bands.of(len(shingles)) if len(shingles) else []
            own, left = signatures(shingles, in_bands) if first.get(hashes[at]) == at else (np.empty(0, np.uint64), [0])
            made["matching"].append(left[0])
            made["least"].append(min(left))
            made["signatures"].append(own.view(np.int64))
        return made

    fields = "n_shingles bigint, hi bigint, lo bigint, matching int, least int, parity array<bigint>, signatures array<bigint>"
    return materialise(map_texts(docs, id_col, text_col, fields, per_slice, with_ids=True).withColumnRenamed(id_col, "id"))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Rows (id, n_shingles, component_id), one per row of ``docs``."""
    wide = index_documents(docs, id_col, text_col, percent)
    indexed = materialise(wide.drop("signatures"))
    full = indexed.filter(F.col("n_shingles") > 0)
    sets = materialise(full.groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    # Of equal sets the smallest id stands for all; it has signatures, being the smallest of its slice too.
    copies = full.select("id", "hi", "lo").join(sets.filter("copies > 1"), ["hi", "lo"]).filter(F.col("id") != F.col("rep")).select("id")
    given = wide.filter(F.size("signatures") > 0).join(broadcast_if_small(materialise(copies.distinct())), "id", "left_anti")
    as_rows = lambda df: df.select(F.explode("signatures").alias("signature"), "id")
    buckets = shared_buckets(as_rows(given), as_rows(given.filter(F.pmod(F.xxhash64("hi", "id"), F.lit(SAMPLE)) == 0)))
    discard(wide)
    known = full.select("id", "n_shingles", "matching", "least", "parity").distinct()
    for _ in range(2):
        buckets, members = _viable(buckets, known, percent)
    groups = resolve(buckets, members.select("id", "n_shingles", "parity"), lambda a, b: _close(a, b, percent),
                     lambda pairs: _verified(docs, id_col, text_col, pairs, percent), lambda pairs: _fitting(pairs, members, percent))
    changed = sets.join(groups, sets["rep"] == groups["node"], "left").select(
        "hi", "lo", "copies", "rep", F.coalesce("component", "rep").alias("component")).filter(
        (F.col("copies") > 1) | (F.col("component") != F.col("rep"))).select("hi", "lo", "component")
    none = indexed.filter(F.col("n_shingles") == 0)
    return (full.join(changed, ["hi", "lo"], "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
            .union(none.select("id", "n_shingles", F.col("id"))).withColumnRenamed("id", id_col))


def _viable(buckets: DataFrame, known: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The buckets without sets that share too few signatures to link with any, and the counts (``shared``) of those left.

    A set of n shingles differs from one it links with in at most ``n (1 + 1 / t) (1 - t) / (1 + t)`` shingles.
    """
    shared = buckets.groupBy("id").agg(F.count(F.lit(1)).alias("shared")).join(known, "id")
    most = F.floor(F.col("n_shingles") * (100 + percent) * (100 - percent) / F.lit(percent * (100 + percent)))
    shared = shared.withColumn("least", F.greatest(F.col("least") - most, F.lit(1)))
    members = materialise(shared.filter(F.col("shared") >= F.col("least")))
    rows = buckets.select("signature", "id").join(members.select("id"), "id", "left_semi")
    hubs = rows.groupBy("signature").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter(F.col("hub") != F.col("last"))
    return materialise(rows.join(hubs.drop("last"), "signature")), members


def _differing(a: str, b: str, percent: int) -> Column:
    """The most elements that are in one of two linked sets only; endings name the sizes."""
    return F.floor((F.col(f"n_shingles{a}") + F.col(f"n_shingles{b}")) * (100 - percent) / F.lit(100 + percent))


def _close(a: str, b: str, percent: int) -> Column:
    """Sizes must fit, and parities differ in no more places than linked sets do in elements."""
    sizes = F.col(f"n_shingles{a}"), F.col(f"n_shingles{b}")
    return ((100 * F.least(*sizes) >= percent * F.greatest(*sizes))
            & (places_apart(F.col(f"parity{a}"), F.col(f"parity{b}"), PARITY_WORDS) <= _differing(a, b, percent)))


def _fitting(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs that can link by the signatures they share.

    All segments of the smaller set's band but for the differing and empty ones share a signature, so each set must have at
    least so many signatures in shared buckets.
    """
    members = members.drop("parity")
    named = [members.withColumnsRenamed({c: c if c == "id" else f"{c}_{x}" for c in members.columns}).withColumnRenamed("id", x) for x in "ab"]
    sized = pairs.join(named[0], "a").join(named[1], "b")
    a_smaller = F.struct("n_shingles_a", "a") < F.struct("n_shingles_b", "b")
    needed = F.when(a_smaller, F.col("matching_a")).otherwise(F.col("matching_b")) - _differing("_a", "_b", percent)
    return sized.filter(F.coalesce("common", F.least("shared_a", "shared_b")) >= needed).select("a", "b")


def _verified(docs: DataFrame, id_col: str, text_col: str, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets link."""
    nodes = materialise(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    chosen = docs.select(docs[id_col].alias("node"), docs[text_col].alias("text")).join(broadcast_if_small(nodes), "node", "left_semi")
    sets = materialise(map_texts(chosen, "node", "text", "shingles array<bigint>",
                                 lambda texts: {"shingles": [shingle_set(t).view(np.int64) for t in texts]}))
    both = pairs.join(sets.withColumnsRenamed({"node": "b", "shingles": "set_b"}), "b").join(
        sets.withColumnsRenamed({"node": "a", "shingles": "set_a"}), "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    total = F.size("set_a") + F.size("set_b")
    return materialise(both.filter((100 + percent) * shared.cast("bigint") >= percent * total.cast("bigint")).select("a", "b").distinct())


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents without those that have a smaller id in their component, all columns as they are."""
    linked = link_documents(docs, id_col, text_col, percent)
    losers = linked.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("loser")).distinct()
    losers = broadcast_if_small(materialise(losers))
    return docs.join(losers, docs[id_col] == losers["loser"], "left_anti")
