"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (all rows with one text) are sorted by size, and each enters the bin with the tightest remaining capacity that still
holds it, found in a balanced tree of the bins. ``pack`` does that for items and a fixed capacity with as few bins as it can;
``assign_shards`` finds the smallest capacity at which a given number of bins is enough, so that sizes come out near equal.

**Scale.** Only the packing itself is sequential, so what enters it is bounded by a parameter: groups above
``1 / parcels`` of all bytes (at most ``parcels`` of them) enter alone, all lighter groups are hashed into ``parcels`` parcels
first. Parcels keep groups whole. A group larger than a fair share gets a shard of its own, as it can't be split.
Sizes, group totals and slots are computed in parallel; a slot is the number of rows in earlier blocks of the shard plus the
place within the block, and blocks are cut by row, so a group with any share of all rows spreads over many tasks.

Cases: a NULL text has no bytes and belongs to the group of empty texts; repeated rows are rows like any other (equal rows
share a shard and get slots one after another); an empty table gives an empty table; equal sizes are taken in key order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from invoicelens.session import materialise

OVERHEAD = 8
PARCELS = 8192
BLOCK_ROWS = 20_000


class BinTree:
    """Bins by remaining capacity in a height-balanced (AVL) search tree; keys are (remaining, bin)."""

    def __init__(self) -> None:
        self._root: list | None = None  # [key, height, left, right]

    def insert(self, key: tuple[int, int]) -> None:
        self._root = self._insert(self._root, key)

    def pop_tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the bin with the least remaining capacity that is at least ``size``."""
        node, best = self._root, None
        while node:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            self._root = self._remove(self._root, best)
        return best

    def _insert(self, node, key):
        if node is None:
            return [key, 1, None, None]
        side = 2 if key < node[0] else 3
        node[side] = self._insert(node[side], key)
        return self._balanced(node)

    def _remove(self, node, key):
        if key != node[0]:
            side = 2 if key < node[0] else 3
            node[side] = self._remove(node[side], key)
        elif node[2] is None or node[3] is None:
            return node[2] or node[3]
        else:
            after = node[3]
            while after[2]:
                after = after[2]
            node[0] = after[0]
            node[3] = self._remove(node[3], after[0])
        return self._balanced(node)

    @staticmethod
    def _height(node) -> int:
        return node[1] if node else 0

    def _measure(self, node) -> None:
        node[1] = 1 + max(self._height(node[2]), self._height(node[3]))

    def _rotate(self, node, side: int):
        """The child on ``side`` comes up."""
        up, other = node[side], 5 - side
        node[side], up[other] = up[other], node
        self._measure(node)
        self._measure(up)
        return up

    def _balanced(self, node):
        self._measure(node)
        lean = self._height(node[2]) - self._height(node[3])
        if abs(lean) < 2:
            return node
        side, other = (2, 3) if lean > 0 else (3, 2)
        if self._height(node[side][other]) > self._height(node[side][side]):
            node[side] = self._rotate(node[side], other)
        return self._rotate(node, side)


def pack(items: list[tuple[int, object]], capacity: int, most_bins: int | None = None) -> dict[object, int] | None:
    """Best fit decreasing: the bin of each key, for (size, key) items of at most ``capacity``.

    Opens a bin only when no open one has room; with ``most_bins``, None when more would be needed.
    """
    tree, opened, placed = BinTree(), 0, {}
    for size, key in sorted(items, key=lambda item: (-item[0], item[1])):
        found = tree.pop_tightest(size)
        if found is None:
            if size > capacity or opened == most_bins:
                return None
            found = (capacity, opened)
            opened += 1
        placed[key] = found[1]
        tree.insert((found[0] - size, found[1]))
    return placed


def pack_evenly(items: list[tuple[int, object]], bins: int) -> dict[object, int]:
    """``pack`` into ``bins`` bins at the smallest capacity that it finds; oversized items get bins of their own first."""
    rest = sorted(items, key=lambda item: (-item[0], item[1]))
    placed: dict[object, int] = {}
    free = bins
    while rest and free > 1 and rest[0][0] * free > sum(size for size, _ in rest):
        free -= 1
        placed[rest.pop(0)[1]] = free
    if not rest:
        return placed
    total = sum(size for size, _ in rest)
    low, high = -(-total // free), -(-total // free) + rest[0][0]
    best = pack(rest, high, free)
    while low < high:
        middle = (low + high) // 2
        tried = pack(rest, middle, free)
        if tried is None:
            low = middle + 1
        else:
            best, high = tried, middle
    return {**placed, **best}


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", parcels: int = PARCELS) -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot): one per row of ``docs``, rows of one text in one shard, bytes near equal."""
    raw = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    rows = materialise(docs.select(
        docs[id_col], (F.octet_length(raw) + OVERHEAD).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.unhex(F.md5(raw)).alias("group")))
    parcel = F.pmod(F.xxhash64("group"), F.lit(parcels)).cast("int")
    rows = rows.withColumn("parcel", parcel)
    groups = materialise(rows.groupBy("group", "parcel").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")))
    totals = groups.agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).first()
    if not totals["rows"]:
        return rows.select(id_col, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    heavy = F.col("bytes") * parcels >= totals["bytes"]
    alone = [(r["bytes"], bytes(r["group"])) for r in groups.filter(heavy).select("bytes", "group").collect()]  # at most `parcels`
    light = [(r["bytes"], r["parcel"]) for r in groups.filter(~heavy).groupBy("parcel").agg(F.sum("bytes").alias("bytes")).collect()]
    bins = pack_evenly([(b, (0, g)) for b, g in alone] + [(b, (1, p)) for b, p in light], shards)
    spark = docs.sparkSession
    # Both lists have at most `parcels` rows.
    of_group = spark.createDataFrame([(bytearray(g), bins[0, g]) for _, g in alone], "`group` binary, own_shard int")
    of_parcel = spark.createDataFrame([(p, bins[1, p]) for _, p in light], "parcel int, parcel_shard int")
    placed = rows.join(F.broadcast(of_group), "group", "left").join(F.broadcast(of_parcel), "parcel", "left").select(
        id_col, "size", "text_crc32", F.coalesce("own_shard", "parcel_shard").alias("shard"))
    return _slots(placed, id_col, shards, totals["rows"])


def _slots(placed: DataFrame, id_col: str, shards: int, n_rows: int) -> DataFrame:
    """A gapless number from 0 within each shard, by blocks of about ``BLOCK_ROWS`` rows."""
    blocks = -(-n_rows // (shards * BLOCK_ROWS))
    own = [c for c in placed.columns if c != "shard"]
    placed = placed.withColumn("block", F.pmod(F.xxhash64(*own), F.lit(blocks)))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("rows")).select(
        "shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy(*own)) - 1
    return placed.select("*", within.alias("place")).join(starts, ["shard", "block"]).select(
        *own, "shard", (F.col("start") + F.col("place")).alias("slot"))
