"""Parities leave out unlike pairs before they are compared, and never a pair that links."""

import random

import numpy as np
from pyspark.sql import functions as F

from invoicelens.llm import jaccard_join as jaccard, line_dedup as lines
from invoicelens.llm.buckets import ascending, parities, places_apart, resolve
from invoicelens.session import materialise


def test_common_elements_cancel_out():
    pick = random.Random(1)
    for words in (1, 2, 8):
        for _ in range(50):
            a, b = ({pick.getrandbits(64) for _ in range(pick.randint(0, 60))} for _ in "ab")
            b |= set(pick.sample(sorted(a), len(a) // 2))
            values = np.array([*sorted(a), *sorted(b)], np.uint64)
            x, y = parities(values, np.repeat([0, 1], [len(a), len(b)]), 2, words)
            apart = sum(int(n).bit_count() for n in (x ^ y).view(np.uint64))
            assert apart <= len(a ^ b) and apart % 2 == len(a ^ b) % 2
    assert ascending(np.array([1, 1, 2, 5, 5])).tolist() == [1, 2, 5] and ascending(np.empty(0)).tolist() == []


def test_places_apart(spark):
    row = spark.createDataFrame([([1, -1], [2, 0])], "a array<bigint>, b array<bigint>")
    assert row.select(places_apart(F.col("a"), F.col("b"), 2)).first()[0] == 66


def _linked_lines(pick):
    n = pick.randint(5, 60)
    a = [b"w%d" % pick.randrange(50) for _ in range(n)]
    b = list(a)
    for _ in range(n // 4):
        at = pick.randrange(len(b))
        b[at:at + 1] = pick.choice([[b"z%d" % pick.randrange(99)], [], [b[at], b"y%d" % pick.randrange(99)]])
        if not b:
            return a, a
    return a, b


def test_no_linked_pair_is_left_out(spark):
    pick = random.Random(2)
    pairs = [p for p in (_linked_lines(pick) for _ in range(2000)) if len(p[1]) >= 5 and lines.similar(*p)]
    levels = np.zeros((1 << lines.WORD_SLOTS) + (1 << lines.PAIR_SLOTS), np.uint8)
    parity = [lines.rarest_pairs(list(side), levels, 5, 80)[1].to_pylist() for side in zip(*pairs)]
    rows = [(len(a), x, len(b), y) for (a, b), x, y in zip(pairs, *parity)]
    df = spark.createDataFrame(rows, "n_a int, parity_a array<bigint>, n_b int, parity_b array<bigint>")
    assert len(rows) > 500 and df.filter(~lines._close("_a", "_b", 80)).count() == 0
    rows = []
    for _ in range(1000):
        a = {pick.getrandbits(64) for _ in range(pick.randint(1, 400))}
        b = (a - set(pick.sample(sorted(a), pick.randint(0, len(a) // 5)))) | {pick.getrandbits(64) for _ in range(pick.randint(0, len(a) // 4))}
        if b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = parities(np.array([*a, *b], np.uint64), np.repeat([0, 1], [len(a), len(b)]), 2, jaccard.PARITY_WORDS).tolist()
            rows.append((len(a), x, len(b), y))
    df = spark.createDataFrame(rows, "n_shingles_a int, parity_a array<bigint>, n_shingles_b int, parity_b array<bigint>")
    assert len(rows) > 300 and df.filter(~jaccard._close("_a", "_b", 80)).count() == 0


def test_a_bucket_of_unlike_members_gives_no_pairs_to_compare(spark):
    """400 unlike members and two alike, none of them the hub: only the two are compared."""
    pick = random.Random(3)
    sets = [[pick.getrandbits(64) for _ in range(100)] for _ in range(400)]
    sets.append(sets[-1][:95] + [pick.getrandbits(64) for _ in range(5)])
    parity = parities(np.array(sum(sets, []), np.uint64), np.repeat(np.arange(401), 100), 401, jaccard.PARITY_WORDS).tolist()
    traits = spark.createDataFrame([(i, 100, p) for i, p in enumerate(parity)], "id bigint, n_shingles bigint, parity array<bigint>")
    buckets = spark.range(401).select(F.lit(1).cast("bigint").alias("signature"), "id", F.lit(0).cast("bigint").alias("hub"))
    seen = []

    def verified(pairs):
        seen.extend(map(tuple, pairs.collect()))
        return materialise(pairs)

    groups = resolve(buckets, traits, lambda a, b: jaccard._close(a, b, 80), verified)
    assert seen == [(399, 400)] and sorted(map(tuple, groups.collect())) == [(399, 399), (400, 399)]
