"""Spelling variants and vector search against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from invoicelens.llm import pivot_search as ps, queries, spelling_variants as sv

FOLDER = "/root/testdata/sf0.001"


def counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) & 0xFFFFFFFF
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def grouped(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[word] = best if best is not None and counts[best] >= 5 * counts[word] else None
    out = set()
    for word in counts:
        root = word
        while form[root] is not None:
            root = form[root]
        out.add((word, form[word], root, counts[word], len(near[word]), counts[form[word]] if form[word] else None))
    return out


def test_variants_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_spelling_variants(spark, FOLDER).collect()
    assert {tuple(r) for r in got} == grouped(counted(rows)) and got[0].asDict().keys() == {"word", "form", "root", "n", "n_near", "form_n"}


def test_chains_long_and_accented_words(spark):
    pick = random.Random(3)
    counts = {"abcdef": 5, "abcdeg": 25, "abcdg": 125, "abbdg": 700, "abbég": 4000, "y" * 9000: 5, "y" * 9001: 60, "y" * 9002: 60,
              "z" * 63: 5, "z" * 64: 30, "z" * 65: 6, "z" * 66: 7, "z" * 64 + "b": 9}
    for _ in range(600):
        word = "".join(pick.choice("abé") for _ in range(pick.randint(6, 9)))
        counts[word] = pick.choice([5, 7, 25, 26, 130])
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    for symbols in (2, 8):
        assert {tuple(r) for r in sv.group_variants(words, symbols).collect()} == grouped(counts)
    assert sv.group_variants(words.limit(0)).count() == 0


def test_word_counts(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = counted([(i, t) for i, t in rows])
    assert {r["word"]: r["n"] for r in sv.count_words(odd_docs).collect()} == want
    assert sv.count_words(no_docs).count() == 0
    damaged = [(i, "Wonderful Études× ") for i in range(600)]
    frame = spark.createDataFrame(damaged * 5, "doc_id bigint, text string")
    assert {r["word"]: r["n"] for r in sv.count_words(frame).collect()} == counted(damaged * 5)


def test_neighbour_keys_are_those_of_the_neighbours():
    pick = random.Random(4)
    for n in (1, 2, 6, 9):
        rows = np.array([[pick.randint(1, 3) for _ in range(n)]], np.uint64)
        word = tuple(int(x) for x in rows[0])
        around = {word} | {word[:i] + word[i + 1:] for i in range(n)}
        around |= {word[:i] + (s,) + word[i + 1:] for i in range(n) for s in range(word[i] + 1, 4)}
        keys = {int(sv.own_keys(np.array([w], np.uint64).reshape(1, -1))[0]) for w in around}
        assert keys == {int(k) for k in sv.neighbour_keys(rows, 3).ravel()}


def best_by_hand(rows, k=10):
    whole = [(i, [int(x) for x in np.floor(np.array(v, dtype=float) * 1024)]) for i, v in rows
             if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (query, q) in enumerate(whole):
        if query is None or query % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i is None, i or 0) for n, (i, v) in enumerate(whole) if n != at)
        out += [(query, rank, None if null else i, -score) for rank, (score, null, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def test_search_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    got = queries.op13_pivot_search(spark, FOLDER)
    assert sorted(map(tuple, got.collect()), key=str) == best_by_hand(rows)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}


def test_odd_vectors_and_several_blocks(spark, monkeypatch):
    pick, nan = np.random.default_rng(5), float("nan")
    rows = [(i, [float(x) for x in pick.normal(size=6).round(1)]) for i in range(0, 3000, 3)]
    rows += [(100, [1.0, 2.0]), (100, [1.0, 2.0]), (200, None), (300, [None, 1.0]), (400, [nan]), (500, [float("inf")]), (600, []),
             (None, [1.0] * 6), (None, None), (-100, [-1e-20, 0.5]), (1, [0.0] * 6), (700, [3e10] * 6), (2, [3e10, -3e10])]
    rows += [(5, [9.0] * 6)] * 30
    pick.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, score int").repartition(5)
    small = [(i, v) for i, v in rows if v is None or not any(x is not None and abs(x) > 1e9 for x in v)]
    for part, chosen in ((frame.filter("forall(coalesce(embedding, array()), x -> x is null or isnan(x) or abs(x) <= 1e9 or abs(x) = double('inf'))"), small),):
        for size in (ps.BLOCK_BYTES, 1200):
            monkeypatch.setattr(ps, "BLOCK_BYTES", size)
            got = ps.top_k(part, ps.F.col("id") % 100 == 0, 10).collect()
            assert sorted(map(tuple, got), key=str) == best_by_hand(chosen)
    assert ps.top_k(frame.limit(0), ps.F.col("id") % 100 == 0).count() == 0
    huge = spark.createDataFrame([(0, [float(2 ** 18)] * 3), (1, [float(2 ** 24) + 0.5, 1.0, -3.0])], "vec_id int, embedding array<double>")
    assert sorted(map(tuple, ps.top_k(huge, ps.F.col("id") % 100 == 0).collect())) == best_by_hand(
        [(0, [float(2 ** 18)] * 3), (1, [float(2 ** 24) + 0.5, 1.0, -3.0])])
