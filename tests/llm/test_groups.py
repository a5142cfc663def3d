"""Operators that bring documents together."""

import random
import zlib
from collections import Counter

import pytest

from invoicelens.llm import bin_packing as bins, jaccard_join as jaccard, line_dedup as lines
from invoicelens.llm.components import connected_components


class Forest:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def root(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    pick = random.Random(1)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5300)]
    wanted = Forest({v for e in edges for v in e})
    for a, b in edges:
        wanted.join(a, b)
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    loops = {a for a, b in edges if a == b}
    assert all(found.get(v, v) == wanted.root(v) for v in wanted.up) and set(wanted.up) - set(found) <= loops
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_best_fit_decreasing_against_a_plain_search():
    pick = random.Random(2)
    for _ in range(60):
        items = [(pick.randint(0, 100) ** pick.choice([1, 2]), i) for i in range(pick.randint(0, 300))]
        capacity = max([s for s, _ in items], default=1) + 50
        left, wanted = [], {}
        for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
            fits = [(room, b) for b, room in enumerate(left) if room >= size]
            b = min(fits)[1] if fits else len(left)
            if not fits:
                left.append(capacity)
            left[b] -= size
            wanted[key] = b
        assert bins.pack(items, capacity) == wanted
        shards = pick.randint(1, 9)
        assert all(0 <= b < shards for b in bins.pack_evenly(items, shards).values())


def test_shards_are_even_whole_and_gapless(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = bins.assign_shards(docs, 24).join(docs.select("doc_id", "text"), "doc_id").collect()
    by_shard, by_text = {}, {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r)
        by_text.setdefault(r["text"], set()).add(r["shard"])
        assert r["size"] == len(r["text"].encode()) + 8 and r["text_crc32"] == zlib.crc32(r["text"].encode())
    assert len(rows) == docs.count() and set(by_shard) == set(range(24)) and all(len(s) == 1 for s in by_text.values())
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in by_shard.values())
    totals = [sum(r["size"] for r in own) for own in by_shard.values()]
    assert max(totals) <= 1.02 * min(totals)
    odd = bins.assign_shards(odd_docs, 4).collect()
    assert sorted((r["shard"], r["slot"]) for r in odd) == sorted({(r["shard"], r["slot"]) for r in odd}) and len(odd) == odd_docs.count()
    assert bins.assign_shards(no_docs, 4).count() == 0


def near(words, pick):
    words = list(words)
    for _ in range(pick.choice([0, 1, 1, 2, 3])):
        if words:
            words[pick.randrange(len(words))] = "w%d" % pick.randrange(10 ** 6)
    return words


def test_links_against_brute_force(spark):
    pick = random.Random(5)
    texts, docs = [], []
    for i in range(700):
        words = near(pick.choice(texts), pick) if texts and pick.random() < 0.6 else [
            "w%d" % pick.randrange(pick.choice([4, 5000])) for _ in range(int(2 ** pick.uniform(0, 9)))]
        texts.append(words)
        docs.append((i, " ".join(words)))
    docs += [(2000, None), (2001, ""), (2002, "  ")]
    sets = {i: set(jaccard.shingle_set(t or "").tolist()) for i, t in docs}
    forest, by_element = Forest(sets), {}
    for a in sorted(sets):
        for b in {x for e in sets[a] for x in by_element.get(e, ())}:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                forest.join(a, b)
        for e in sets[a]:
            by_element.setdefault(e, []).append(a)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
             jaccard.link_documents(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()}
    assert found == {i: (len(s), forest.root(i)) for i, s in sets.items()}


def test_signatures_cover_every_linked_pair():
    pick = random.Random(6)
    bands = jaccard.Bands(10 ** 6)
    for _ in range(1500):
        a = {pick.getrandbits(63) for _ in range(int(2 ** pick.uniform(0, 9)))}
        most = len(a) * 20 // 100
        gone = set(pick.sample(sorted(a), pick.randint(0, most)))
        b = (a - gone) | {pick.getrandbits(63) for _ in range(pick.randint(0, max(0, len(a) // 4)))}
        if a != b and b and 100 * len(a & b) >= 80 * len(a | b):
            own = [set(jaccard.signatures(jaccard.np.array(sorted(s), jaccard.np.uint64), bands.of(len(s)))[0].tolist()) for s in (a, b)]
            assert own[0] & own[1]


def test_odd_rows_of_the_join(odd_docs, no_docs):
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(odd_docs).collect()]
    assert len(rows) == odd_docs.count() and rows.count((5, 1, 5)) == 2 and (None, 1, 5) in rows and (1, 0, 1) in rows
    assert jaccard.link_documents(no_docs).count() == 0
    kept = jaccard.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns


@pytest.fixture(scope="module")
def paragraphs(spark):
    pick = random.Random(3)
    base = [" ".join("w%d" % pick.randrange(3000) for _ in range(60)) for _ in range(20)]

    def changed(text):
        words = text.split()
        words[pick.randrange(len(words))] = "zz"
        return " ".join(words)

    docs = []
    for i in range(60):
        own = [" ".join("u%d" % pick.randrange(10 ** 6) for _ in range(30)) for _ in range(3)]
        for _ in range(2):
            own.insert(pick.randrange(4), pick.choice([lambda t: t, changed, lambda t: t.upper() + "!"])(pick.choice(base)))
        docs.append((i, "\n".join(own)))
    return docs


def test_line_groups_against_brute_force(spark, paragraphs):
    places = [(i, n) for i, t in paragraphs for n in range(len(t.split("\n")))]
    words = {(i, n): w for i, t in paragraphs for n, w in enumerate(lines.normal_lines(t))}
    forest = Forest(places)
    for x, a in enumerate(places):
        for b in places[:x]:
            if lines.similar(words[a], words[b]):
                forest.join(a, b)
    wanted = {p for p in places if forest.root(p) != p}
    rows = lines.lines_to_drop(spark.createDataFrame(paragraphs, "doc_id bigint, text string")).collect()
    found = {(r["id"], n) for r in rows for n in r["dropped"]}
    assert found <= wanted and len(found) >= 0.97 * len(wanted)


def repeats_by_hand(docs):
    """All repeats among the lines of (id, text), each line against each; also the numbers of exact ones and of similar kinds."""
    kinds = {}
    for i, text in sorted(docs):
        for n, (words, raw) in enumerate(zip(lines.normal_lines(text), text.split("\n"))):
            if words or raw.strip():
                kinds.setdefault(tuple(words) or raw.strip(), []).append((i, n))
    forest = Forest(kinds[k][0] for k in kinds)
    long = sorted((k for k in kinds if isinstance(k, tuple) and len(k) >= lines.MIN_WORDS), key=len)
    counted = [Counter(k) for k in long]
    for x, a in enumerate(long):
        for y in range(x):
            if 5 * len(long[y]) >= 4 * len(a) and 5 * (counted[x] & counted[y]).total() >= 4 * len(a) and lines.similar(a, long[y]):
                forest.join(kinds[a][0], kinds[long[y]][0])
    exact = {p for own in kinds.values() for p in own[1:]}
    return exact | {own[0] for own in kinds.values() if forest.root(own[0]) != own[0]}, exact


def found_repeats(spark, docs, **more):
    rows = lines.lines_to_drop(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), **more).collect()
    return {(r["id"], n) for r in rows for n in r["dropped"]}


def test_all_similar_lines_of_any_length_are_found(spark):
    pick = random.Random(9)
    docs = []
    for i in range(400):
        n = 5 + i % 36
        words = ["w%d" % pick.randrange(400) for _ in range(n)]
        other = list(words)
        for _ in range(n // 5):
            at = pick.randrange(len(other))
            how = pick.randrange(3)
            other[at:at + 1] = [["zz%d" % pick.randrange(99)], [], [other[at], "yy%d" % pick.randrange(99)]][how]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    wanted, exact = repeats_by_hand(docs)
    assert len(wanted - exact) > 300 and found_repeats(spark, docs) == wanted


def test_repeats_of_short_and_unspaced_lines(spark):
    chinese, other = "今天天气很好我们一起去公园", "今天天气很好我们一同去公园"
    docs = [(1, "Menu\n\n---\n\u201cHome\u201d \u2013 one\u00a0two\n" + chinese + "\nno twin"), (2, "menu\n\n---\nHome one two\n" + other + "\n \n***")]
    assert found_repeats(spark, docs) == {(2, 0), (2, 2), (2, 3), (2, 4)}
    assert lines.normal_lines("ÉtÉ ไทย 日本のx9\nहिन्दी") == [[w.encode() for w in "été ไ ท ย 日 本 の x9".split()], ["हिन्दी".encode()]]


def test_all_repeats_of_the_given_documents_are_found(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    wanted, exact = repeats_by_hand(docs)
    assert len(exact) > 50 and len(wanted) > len(exact) and found_repeats(spark, docs) == wanted


def test_edits_against_the_table():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return row[-1]
    pick = random.Random(8)
    for _ in range(500):
        a, b = ([pick.choice("abcd") for _ in range(pick.randint(0, 70))] for _ in "ab")
        assert lines.edits(a, b) == plain(a, b)


def test_odd_rows_of_line_dedup(odd_docs, no_docs):
    out = lines.dedup_lines(odd_docs, count_as="removed")
    rows = {r["node"]: r for r in out.collect()}
    assert len(rows) == odd_docs.count() and out.columns == [*odd_docs.columns, "removed"]
    assert rows[0]["text"] is None and rows[1]["text"] == "" and rows[2]["text"] == " \n\t \n"
    assert [rows[n]["text"] for n in (4, 5, 6)] == ["", "", "a b c d e"]  # NULL comes first
    assert lines.dedup_lines(no_docs).count() == 0
