"""Operators that look at each document by itself."""

import random
import re
import textwrap
import zlib

import numpy as np

from invoicelens.llm import additive_model as gam, license_join, personal_data as pii, quality_rules as rules, wu_manber as wm


def repeats_by_hand(words, size=8):
    windows = [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]
    return len({p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + size)})


def test_repeated_words():
    pick = random.Random(1)
    for _ in range(200):
        words = [pick.choice([b"a", b"b", b"c"]) for _ in range(pick.randint(0, 60))]
        if pick.random() < 0.5:
            words = [b"%d" % pick.randrange(40) for _ in range(30)] * pick.randint(1, 3)
        assert rules.repeated_words(words) == repeats_by_hand(words)


def test_rule_order_never_changes_a_verdict(spark, odd_docs, no_docs, texts):
    for text in texts:
        measured = rules.Measured(text)
        assert rules.passes(measured, rules.RULES) == rules.passes(rules.Measured(text), rules.RULES[::-1])
    rows = rules.measure_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count() and not any(r["kept"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert rules.filter_documents(odd_docs).columns == odd_docs.columns
    assert rules.measure_documents(no_docs).count() == rules.filter_documents(no_docs).count() == 0


def test_cascade_keeps_what_is_labelled_good(spark):
    folder = "/root/testdata/sf0.01"
    kept = rules.measure_documents(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "kept", "base_failed")
    rows = kept.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0]
    assert all(r["kept"] for r in good) and sum(not r["kept"] for r in bad) >= 0.95 * len(bad)


def windows_by_hand(items, words):
    hit, own = set(), set()
    for item, text in items:
        for window in wm.windows_of(wm.words_of(text)):
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i:i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    own.add(item)
    return hit, own


def test_search_against_brute_force():
    pick = random.Random(2)
    for _ in range(300):
        vocabulary = ["%d" % i for i in range(pick.choice([2, 3, 50]))]
        items = [(i, " ".join(pick.choice(vocabulary) for _ in range(pick.choice([0, 1, 3, 9, 10, 11, 14])))) for i in range(4)]
        words = [pick.choice(vocabulary).encode() for _ in range(pick.randint(0, 60))]
        words[5:5] = wm.words_of(items[3][1])
        spans, own = wm.Searcher(items).hits(words)
        assert ({p for a, b in spans for p in range(a, b)}, own) == windows_by_hand(items, words)


def test_search_in_parts_and_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "A b C d e"), (2, None), (3, ""), (None, "one"), (5, "same words " * 6), (1, "A b C d e")],
                                  "item_id bigint, text string")
    whole = {(r["doc_id"], r["n_hit"], r["n_items"]) for r in wm.digest(wm.search_documents(odd_docs, items)).collect()}
    parts = {(r["doc_id"], r["n_hit"], r["n_items"]) for r in wm.digest(wm.search_documents(odd_docs, items, part_bytes=8)).collect()}
    assert whole == parts and (5, 5, 1) in whole and (7, 6000, 1) in whole
    assert sorted(r["node"] for r in wm.drop_contaminated(odd_docs, items).collect()) == [0, 1, 2, 7, 9, 10, 11]
    assert wm.search_documents(no_docs, items).count() == 0
    assert not any(r["contaminated"] for r in wm.digest(wm.search_documents(odd_docs, items.limit(0))).collect())


def test_license_join_against_brute_force(spark, odd_docs, no_docs):
    pick = random.Random(4)
    sets = [(label, license_join.template_words(text)) for label, text in license_join.TEMPLATES]
    docs = []
    for n in range(150):
        lines = []
        for _ in range(pick.randint(0, 4)):
            words = list(pick.choice(sets)[1])
            pick.shuffle(words)
            lines.append(" ".join(words[pick.randint(0, 3):] + ["other"] * pick.randint(0, 2)))
        docs.append((n, "\n".join(lines)))
    found = {r["doc_id"]: r for r in license_join.scan_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for n, text in docs:
        labels = {label for label, words in sets for line in text.split("\n") if len(set(words) & set(line.split())) >= 0.8 * len(words) - 1e-9}
        assert set(found[n]["labels"]) == labels | set(found[n]["base_labels"])
    rows = license_join.scan_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["score"] == 0 and r["labels"] == [] for r in rows)
    assert license_join.scan_documents(no_docs).count() == 0


def test_wrapped_notices_are_found(spark):
    docs, wanted = [], []
    for label, text in license_join.TEMPLATES:
        for width in (20, 40, 75):
            lines = textwrap.wrap("x " * 9 + text, width)
            docs += [(len(docs), "\n".join(lines)), (len(docs) + 1, "intro\n" + "\n".join(" * " + line for line in lines) + "\nrest of it")]
            wanted += [label] * 2
    rows = {r["doc_id"]: r for r in license_join.scan_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert all(label in rows[n]["labels"] and rows[n]["score"] == 1 for n, label in enumerate(wanted))
    mit = license_join.TEMPLATES[7][1].split()
    apart = "\n".join(" ".join([w] + ["other"] * 9) for w in mit)  # all its words, but in no notice
    backward = "\n".join(reversed(mit))
    assert all(r["labels"] == [] for r in license_join.scan_documents(spark.createDataFrame([(1, apart), (2, backward)], "doc_id bigint, text string")).collect())


def emails_by_hand(text):
    return [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]


def test_base_spans_against_the_patterns():
    pick = random.Random(5)
    for _ in range(3000):
        text = "".join(pick.choice("a@.1 -+(9x_@.2") for _ in range(pick.randint(0, 40)))
        spans = pii.base_spans(text)
        assert [(s, e) for s, k, e in spans if k == "email"] == emails_by_hand(text)
        ips = [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [(s, e) for s, k, e in spans if k == "ip"] == [m.span() for m in ips]
        phones = [m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        assert [(s, e) for s, k, e in spans if k == "phone"] == [m.span() for m in phones]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_repeats_of_personal_data_are_found_by_the_skip_edges(spark, odd_docs, no_docs):
    model = pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    text = "call +1 (988) 555-2485 now\n" + "words " * 300 + "again (988) 555-2485, or 12 apples in 2024 for 30 euros."
    docs = spark.createDataFrame([(1, text), (2, "in 2024 we sold 12 apples, 2024 was good")], "doc_id bigint, text string")
    rows = {r["doc_id"]: [(s["kind"], text[s["start"]:s["end"]]) for s in r["spans"]] for r in pii.find_spans(docs, model).collect()}
    assert rows[1][0] == ("phone", "+1 (988) 555-2485") and rows[1][1][0] == "phone" and "555-2485" in rows[1][1][1] and len(rows[1]) == 2
    assert rows[2] == []
    found = pii.digest(pii.find_spans(odd_docs, model)).collect()
    assert len(found) == odd_docs.count() and all(r["spans"] == "" for r in found)
    assert pii.find_spans(no_docs, model).count() == 0
    assert all(r["spans"] == "" for r in pii.digest(pii.find_spans(odd_docs, pii.train(no_docs))).collect())


def test_messages_are_exact_on_a_chain():
    pick = np.random.default_rng(6)
    k = len(pii.LABELS)
    field = pii.SkipChainField(np.eye(k), pick.normal(size=(k, k)), pick.normal(size=(k, k)))
    graph = pii.Graph(texts=[0] * 3, places=[(0, 1)] * 3, x=pick.normal(size=(3, k)).tolist(), label=[0] * 3, chain=[(0, 1)], skip=[(1, 2)])
    x = np.array(graph.x)
    joint = np.exp(x[0][:, None, None] + x[1][None, :, None] + x[2][None, None, :] + field.chain[:, :, None] + field.skip[None, :, :])
    joint /= joint.sum()
    found = field.marginals(graph)
    assert np.allclose(found, [joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))], atol=1e-4)


def test_additive_model_on_held_out_documents(spark, odd_docs, no_docs):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = gam.train(docs, labels)
    rows = gam.score_documents(docs, model).join(labels, "doc_id").filter(gam.held_out(labels["doc_id"])).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in rows]) > 0.95
    scored = gam.score_documents(odd_docs, model).collect()
    assert len(scored) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert gam.score_documents(no_docs, model).count() == 0
    assert {r["score"] for r in gam.score_documents(odd_docs, gam.train(docs, labels.limit(0))).collect()} == {0.5}


def test_pair_tables_learn_what_single_features_cannot():
    pick = np.random.default_rng(7)
    x = pick.random((4000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x, y)
    assert model.pairs[0] == (0, 1) and np.mean((model.scores(x) > 0.5) == (y == 1)) > 0.95
