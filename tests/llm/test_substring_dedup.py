import hashlib
import random
import re

import numpy as np
import pytest

import __spark_entry__ as entry
from fleetlens.llm import substring_dedup as sd
from fleetlens.llm.common import mix64


def brute(rows, size=13):
    """Per row (key, words, removed words, digest) by a dictionary of all runs."""
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    first = {}
    for (key, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - size + 1):
            run = tuple(w[i:i + size])
            if key is not None and (run not in first or key < first[run]):
                first[run] = key
    out = []
    for (key, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if key is not None and first[tuple(w[i:i + size])] < key:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table_equals_brute_force(spark, sf):
    data = f"/root/testdata/{sf}"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in entry.queries()["op10_substring_dedup"](spark, data).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == brute(rows) and sum(r[2] for r in got) > 0


@pytest.mark.parametrize("shard", [3000, 2])
def test_odd_rows(spark, shard):
    """Few symbols, shared passages with differing surroundings, repeated keys and rows, nulls; small shards take owners apart."""
    r = random.Random(5)
    passage = " ".join(r.choices("abcdefgh", k=40))
    rows = [(k, " ".join(r.choices("ab", k=r.randrange(0, 60)))) for k in range(40)]
    rows += [(100 + k, " ".join([*r.choices("xyz", k=k), *passage.split()[k % 7:30 + k], *r.choices("xyz", k=9)])) for k in range(12)]
    rows += [(1, None), (1, passage), (1, passage), (None, passage), (None, passage), (200, "w " * 3000), (201, "w " * 20), (202, "é" * 30_000), (203, ""), (-5, passage + "\x0b  x")]
    df = spark.createDataFrame([(k, t, 7, "s") for k, t in rows], "doc_id long, text string, start int, owner string")
    got = sd.cut_repeats(df, shard=shard).collect()
    assert sorted(((g["doc_id"], g["n_words"], g["n_removed"], hashlib.sha256(g["kept"].encode()).hexdigest()) for g in got), key=str) == brute(rows)
    assert all(g["n_removed"] == sum(s["end"] - s["start"] for s in g["spans"]) for g in got)
    assert sd.cut_repeats(df.limit(0)).count() == 0


def test_automaton_knows_first_documents():
    r = random.Random(1)
    for _ in range(200):
        texts = [(d, r.choices([1, 2], k=r.randrange(0, 14))) for d in r.sample(range(9), 5)]
        automaton = sd.Automaton()
        for d, t in texts:
            automaton.add(t, d)
        automaton.settle()
        asked = r.choices([1, 2, 3], k=20)
        want = [min((d for d, t in texts if any(t[j:j + 4] == asked[i:i + 4] for j in range(len(t) - 3))), default=None) for i in range(17)]
        assert automaton.first_documents(asked, 4) == want


def test_clashing_names_stay(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, passage + " x", "x", 5, 7), (2, "y " + passage, "y", 6, 8), (3, passage, "z", 1, 2), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _spans string, _key int, _row int")
    df = df.withColumn("spans", df["_key"])
    got = sd.without_repeats(df)
    assert got.columns == df.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == [(*rows[0], 5), (2, "y", "y", 6, 8, 6), (*rows[3], None)]


def test_shards_of_a_batch_are_those_of_single_owners():
    deal = [0, 1, -1, -(2**63), 2**63 - 1, 2**64 - 1]
    assert sd.shards_of(deal, 7).tolist() == [int(mix64(np.array([x % 2**64], np.uint64))[0]) % 7 for x in deal]
    assert sd.shards_of([], 7).tolist() == []
