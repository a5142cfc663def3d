import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from invoicelens.llm import bpe_counts, bpe_transducer as bpe
from invoicelens.llm.pieces import Pieces

RANKS = bpe.load_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
CODEC = bpe.Codec(RANKS, P.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
COUNTER = bpe_counts.TextCounter(open(P.path("byte_bpe_50k.json"), "rb").read(), P.PATTERN)
COUNT_REFERENCE = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
MIXED = st.text(alphabet=st.one_of(st.sampled_from("abcdeth einr  \n\t'.,!0123éèñüß日🙂"), st.characters(exclude_categories=["Cs"])), max_size=200)


def test_ids_and_bytes_are_those_of_the_library(texts):
    for text in texts:
        ids = bpe.split_ids(CODEC.encode(text))
        assert ids == list(map(str, REFERENCE.encode_ordinary(text)))
        assert CODEC.decode(ids) == (text.encode(), text)


@settings(max_examples=300, deadline=None)
@given(MIXED)
def test_any_text_round_trips(text):
    ids = bpe.split_ids(CODEC.encode(text))
    assert ids == list(map(str, REFERENCE.encode_ordinary(text)))
    assert CODEC.decode(ids) == (text.encode(), text)


def test_long_pieces_take_linear_steps():
    for text in ("a" * 100_000, " " * 30_000 + "x", "ab" * 40_000, "é" * 20_000):
        assert bpe.split_ids(CODEC.encode(text)) == list(map(str, REFERENCE.encode_ordinary(text)))


@given(st.binary(max_size=60), st.integers(1, 7))
def test_utf8_machine_agrees_with_the_decoder_however_bytes_are_cut(raw, step):
    machine = bpe.Utf8Machine()
    parts = [machine.feed(raw[i:i + step]) for i in range(0, len(raw), step)]
    assert "".join(parts) + machine.close() == raw.decode("utf-8", "replace")


def test_transducer_follows_the_merges_of_any_vocabulary():
    small = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"ca": 259, b"cab": 260, b"bcab": 261}
    machine = bpe.Transducer(small)
    for n in range(4 ** 6):
        raw = bytes(b"abcd"[n >> 2 * k & 3] for k in range(6))
        assert [machine._bytes_of[t] for t in machine.encode(raw)] == bpe.merge(raw, small)


def test_counts_are_those_of_the_library(texts):
    special = ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endof", ""]
    wanted = [len(e.ids) for e in COUNT_REFERENCE.encode_batch(texts + special, add_special_tokens=False)]
    assert [COUNTER.count(t) for t in texts + special] == wanted


@settings(max_examples=200, deadline=None)
@given(MIXED)
def test_counts_of_any_text(text):
    assert COUNTER.count(text) == len(COUNT_REFERENCE.encode(text, add_special_tokens=False).ids)


@given(MIXED)
def test_pieces_of_latin_texts_are_those_of_the_pattern(text):
    import regex
    assert Pieces(P.PATTERN).of(text) == regex.findall(P.PATTERN, text)


def test_documents_with_odd_rows(odd_docs, no_docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    for row in bpe.digest_documents(odd_docs, path, P.PATTERN).collect():
        if row["doc_id"] in (1, 2):
            assert row["n_tokens"] == 0 and row["ids_sha256"] == row["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    whole = bpe.encode_documents(odd_docs, path, P.PATTERN).join(odd_docs.select("doc_id", "text"), "doc_id")
    assert all(r["decoded"] == (r["text"] or "") for r in whole.collect())
    counts = bpe_counts.count_tokens(odd_docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    assert len(counts) == odd_docs.count() and all(r["over_limit"] == (r["n_tokens"] > 512) for r in counts)
    assert bpe.digest_documents(no_docs, path, P.PATTERN).count() == 0
    assert bpe_counts.count_tokens(no_docs, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


@pytest.mark.parametrize("name", ["op1_byte_bpe", "op6_token_counts"])
def test_queries_over_whole_tables(spark, driver_entry, name):
    folder = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in driver_entry.queries()[name](spark, folder).collect()}
    for doc in spark.read.parquet(f"{folder}/documents.parquet").collect():
        text = doc["text"] or ""
        if name == "op1_byte_bpe":
            ids = REFERENCE.encode_ordinary(text)
            assert rows[doc["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert rows[doc["doc_id"]]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        else:
            assert rows[doc["doc_id"]]["n_tokens"] == len(COUNT_REFERENCE.encode(text, add_special_tokens=False).ids)
