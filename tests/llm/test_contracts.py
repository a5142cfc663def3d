"""Contract columns on odd texts, against the registered SQL and against plain patterns."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa

from invoicelens.llm import personal_data as pii, queries, quality_rules

ODD_PIECES = ["A", "a", "Ab", "Ä", "ä", "ǅ", "ª", "1", "#", "!!", " ", "\u0085", " ", " ", " ", " ", "\n", "\t", "\x0b", "\x1c", "漢"]


def test_quality_rules_equal_their_sql_on_odd_spaces_and_letters(spark, tmp_path):
    pick = random.Random(3)
    texts = ["A b " * 25, "A B " * 25, "A b\u0085 " * 30, "ǅ " * 30, "Aª " * 30, "", None]
    texts += ["".join(pick.choices(ODD_PIECES, k=pick.randint(0, 120))) for _ in range(400)]
    # Arrow's own types, so that both engines read one file.
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "kept": ["clash"] * len(texts)})
    import pyarrow.parquet as pq
    pq.write_table(table, tmp_path / "documents.parquet")
    name = "op10_quality_rules"
    frame = queries.queries()[name](spark, str(tmp_path))
    ours = sorted(tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    theirs = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    assert ours == sorted(tuple(row[names.index(c)] for c in sorted(names)) for row in theirs.fetchall())
    assert quality_rules.capital("A B".encode()) and not quality_rules.capital("A b".encode()) and not quality_rules.capital(b"1")


def base_by_patterns(text):
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        total = sum(digits[0::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            found.append(("card", m))
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    order = ["email", "ip", "card", "phone"]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in sorted(found, key=lambda f: (f[1].start(), order.index(f[0])))]


def test_cards_and_the_hash_of_base_spans(spark):
    pick = random.Random(9)
    texts = ["card 4111 1111 1111 1111 and 4111-1111-1111-1112", "0000000000000", "4111  1111 1111 1111", "é 4111111111111111x", None, ""]
    texts += ["".join(pick.choice("00112358 -4x" if n % 2 else "0011 -4.x+@a") for _ in range(pick.randint(0, 80))) for n in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = {r["doc_id"]: r for r in pii.digest(pii.find_spans(docs, pii.train(docs.limit(0)))).collect()}
    assert len(rows) == len(texts) and sum(r["n_card"] for r in rows.values()) > 20
    for n, text in enumerate(texts):
        spans = base_by_patterns(text or "")
        assert rows[n]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert rows[n]["n_card"] == sum(s.startswith("card") for s in spans)


def test_the_field_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for bound in (20, 4000):
        one, many = pii.train(docs.coalesce(1), train_docs=bound), pii.train(docs.repartition(9), train_docs=bound)
        for name in ("unary", "chain", "skip"):
            assert np.array_equal(getattr(one, name), getattr(many, name)), name
