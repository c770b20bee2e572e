import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetlens.llm import packing, queries

DATA = "/root/testdata/sf0.001"
TRICKY = ["", " ", "  a  b", "a\n\n b\t\tc  ", "it's  they'll x", "\x1c!\x1c!", "<|endoftext|> end", "a<|endoftext|>b", " <|endoftext|> <|endoftext|><|endoftext |>", "<|endoftext|>", "日本語 テキスト", "é" * 300, "a" * 5000, "x   y", "tab\tend\n", "1234 5678,90!!"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return np.frombuffer(packing.word_codes().ids(text), "<u4").tolist()


@pytest.mark.parametrize("text", TRICKY)
def test_ids_are_the_tokenizer_s(tokenizer, text):
    assert ids_of(text) == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.text(alphabet=st.sampled_from("ab 1'\n\t é!　s\x1c"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_ids_of_odd_white_space(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert ids_of(text) == t.encode(text, add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 16), st.integers(1, 40), max_size=12))
@settings(max_examples=200, deadline=None)
def test_plan_fills_each_place_once(counts):
    slots, opened = packing.best_fit_plan(counts, 16)
    used, ranks = defaultdict(list), defaultdict(list)
    for k, (length, rank, first, offset) in enumerate(slots):
        upto = slots[k + 1][1] if k + 1 < len(slots) and slots[k + 1][0] == length else counts[length]
        for r in range(rank, upto):
            ranks[length].append(r)
            used[first + r - rank].append((offset, length))
    assert {n: len(r) for n, r in ranks.items()} == counts and all(sorted(r) == list(range(len(r))) for r in ranks.values())
    assert sorted(used) == list(range(opened))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 16
    # as plain best-fit decreasing
    free = []
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = [f for f in free if f >= length]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - length)
        else:
            free.append(16 - length)
    assert opened == len(free)


def check(rows, texts, tokenizer, size):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    total = 0
    for doc, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and sum(r["length"] for r in pieces) == len(ids)
        assert len(pieces) == -(-len(ids) // size)
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes())
        total += len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return total, len(by_seq)


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    total, sequences = check(queries.op3_best_fit_packing(spark, DATA).collect(), {r["doc_id"]: r["text"] or "" for r in docs}, tokenizer, 1024)
    assert sequences <= 1.02 * total / 1024 + 1


def test_odd_rows(spark, tokenizer):
    texts = {i: t for i, t in enumerate(TRICKY * 3)}
    df = spark.createDataFrame([(i, t or None, "x") for i, t in texts.items()], "doc_id long, text string, length string")
    check(packing.pack_documents(df, size=64).collect(), texts, tokenizer, 64)
    assert packing.pack_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [3000, 8192])
def test_large_sizes_null_keys_and_repeated_rows(spark, tokenizer, size):
    texts = {i: " ".join(f"w{i * 7 + j}" for j in range(i * 37 % 2500)) for i in range(130)}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, length string")
    check(packing.pack_documents(df, size=size).collect(), texts, tokenizer, size)
    rows = packing.pack_documents(spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None), (5, "x"), (5, "x"), (5, "y " * 40)], "doc_id long, text string"), size=16).collect()
    assert sum(r["doc_id"] is None for r in rows) == 3
    places = [(r["sequence_id"], r["offset"] + n) for r in rows for n in range(r["length"])]
    assert len(places) == len(set(places))


def test_full_pieces_are_sequences_of_their_own(spark):
    pieces = spark.createDataFrame([(i, 0, 0, 8 if i % 3 else 1 + i % 7, 0) for i in range(200)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(pieces, size=8).collect()
    places = [(r["sequence_id"], r["offset"] + n) for r in rows for n in range(r["length"])]
    assert len(rows) == 200 and len(places) == len(set(places)) == sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows if r["length"] == 8}) == sum(r["length"] == 8 for r in rows)
