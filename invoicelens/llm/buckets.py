"""Groups of linked things from shared signatures, without comparing all pairs of a bucket.

In a bucket everything is compared with the smallest id, its hub. Members that then are in one component need no more
comparing; where a bucket has several, further hubs are tried, and in the end what is left of different components is
compared pair by pair. So no link is lost, and a bucket of near copies costs about one comparison per member.

**Parities.** Each thing has a short row of bits, and each of its elements flips the bit that the element's hash names. What two
things have in common flips the same bits, so these differ in at most as many places as the elements do. Pairs that differ in
more places than links allow are left out inside the join that finds them; that never loses a link.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from invoicelens.session import materialise

from .components import connected_components

SAMPLE = 64  # one in so many rows shows which buckets are large
LARGE = 64  # rows in the sample of such a bucket
BROADCAST_ROWS = 1_000_000
MORE_HUBS = 1


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast if its rows are few, counted; else left to the planner."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shared_buckets(rows: DataFrame, sampled: DataFrame) -> DataFrame:
    """Rows (signature, id, hub) of the buckets with two ids or more, for rows (signature, id).

    Buckets that ``sampled``, a sample of the rows, shows to be large never meet in one task: their hub is found by partial
    aggregation and sent to the rows. The sample decides on the way only, not on what is found.
    """
    large = materialise(sampled.groupBy("signature").count().filter(F.col("count") >= LARGE).select("signature"))
    large = broadcast_if_small(large)
    bucket = Window.partitionBy("signature")
    cold = (rows.join(large, "signature", "left_anti")
            .select("signature", "id", F.min("id").over(bucket).alias("hub"), F.max("id").over(bucket).alias("last"))
            .filter(F.col("hub") != F.col("last")).drop("last"))
    hot = rows.join(large, "signature", "left_semi")
    hubs = broadcast_if_small(materialise(hot.groupBy("signature").agg(F.min("id").alias("hub"))))
    return materialise(cold.union(hot.join(hubs, "signature").select("signature", "id", "hub")))


def ascending(values: np.ndarray) -> np.ndarray:
    """The distinct values of a sorted array."""
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def parities(hashes: np.ndarray, owner: np.ndarray, owners: int, words: int) -> np.ndarray:
    """Per owner the parities of its 64-bit hashes, as ``words`` (a power of 2) whole numbers; a row each."""
    bits = 64 * words
    place = owner.astype(np.int64) * bits + (hashes >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    odd = (np.bincount(place, minlength=owners * bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(owners, words)


def places_apart(a: Column, b: Column, words: int) -> Column:
    """In how many places two parities differ."""
    apart = F.lit(0)
    for i in range(words):
        apart = apart + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return apart


def resolve(buckets: DataFrame, traits: DataFrame, close: Callable[[str, str], Column], verified: Callable[[DataFrame], DataFrame],
            fitting: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows (node, component) of all ids that link with another, for buckets (signature, id, hub).

    ``traits`` has a row per id; ``close`` makes a condition on two rows of it, their columns named with the given endings,
    without which ids can't link. ``fitting`` drops more pairs (a, b, common); ``common`` counts the buckets of both, where
    known. ``verified`` keeps the pairs that do link.
    """
    def apart(df: DataFrame, end: str) -> DataFrame:
        return df.withColumnsRenamed({c: f"{c}{end}" for c in df.columns})

    def near(pairs: DataFrame) -> DataFrame:
        sized = pairs.withColumnsRenamed({"a": "id_a", "b": "id_b"}).join(apart(traits, "_a"), "id_a").join(apart(traits, "_b"), "id_b")
        found = sized.filter(close("_a", "_b")).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "common")
        return (fitting(found) if fitting else found).select("a", "b")

    tried = materialise(near(_distinct_pairs(buckets.select(F.col("hub").alias("a"), F.col("id").alias("b")))))
    links = verified(tried)
    groups = connected_components(links)
    more_hubs = MORE_HUBS
    while True:
        split = _split(buckets, groups)
        if split.isEmpty():
            break
        last = more_hubs == 0
        if not last:  # the smallest id outside the first one's component, against all other components
            hub = split.filter(F.col("own") != F.col("first")).groupBy("signature").agg(
                F.min("id").alias("a"), F.min_by("own", "id").alias("hub_own"))
            raw = split.join(hub, "signature").filter(F.col("own") != F.col("hub_own")).select("a", F.col("id").alias("b"))
        else:
            named = split.join(traits, "id")
            left, right = apart(named, "_a"), apart(named, "_b")
            raw = left.join(right, (F.col("signature_a") == F.col("signature_b")) & (F.col("id_a") < F.col("id_b"))
                            & (F.col("own_a") != F.col("own_b")) & close("_a", "_b")).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
        fresh = materialise(near(_distinct_pairs(raw, counted=last)).join(tried, ["a", "b"], "left_anti"))
        empty = fresh.isEmpty()
        if empty and last:
            break
        more_hubs = 0 if empty else more_hubs - 1
        if empty:
            continue
        tried = materialise(tried.union(fresh))
        links = materialise(links.union(verified(fresh)))
        groups = connected_components(links)
        if last:
            break
    return groups


def _distinct_pairs(raw: DataFrame, counted: bool = False) -> DataFrame:
    """Pairs a < b, once. Pairs not yet compared are in split buckets only, so ``counted`` rows tell all they share."""
    pairs = raw.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(F.col("a") != F.col("b"))
    common = F.count(F.lit(1)) if counted else F.lit(None).cast("bigint")
    return pairs.groupBy("a", "b").agg(common.alias("common"))


def _split(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (signature, id, own, first) of buckets with several components; ``first`` is the smallest id's.

    Both members of a bucket of two have been compared already.
    """
    named = buckets.join(groups.withColumnsRenamed({"node": "id"}), "id", "left").select(
        "signature", "id", F.coalesce("component", "id").alias("own"))
    spread = named.groupBy("signature").agg(F.min("own").alias("least"), F.max("own").alias("most"), F.min_by("own", "id").alias("first"),
                                             F.count(F.lit(1)).alias("n"))
    spread = spread.filter((F.col("least") != F.col("most")) & (F.col("n") > 2)).select("signature", "first")
    return materialise(named.join(spread, "signature"))
