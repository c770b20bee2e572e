import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fleetlens.llm import merkle
from tests.oracle_check import compare, connect

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos int, tree string, key string, at int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests):
    found = [digests]
    while len(found[-1]) > 1:
        found.append([sha("".join(found[-1][i:i + 8])) for i in range(0, len(found[-1]), 8)])
    return found


def siblings(levels, place):
    for level in levels[:-1]:
        start = place // 8 * 8
        run = level[start:start + 8]
        yield "".join(run[:place - start]), "".join(run[place - start + 1:])
        place //= 8


def brute(rows, late):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for n, g in enumerate(names):
        for place, r in enumerate(groups[g]):
            steps = [*siblings(trees[g], place), *siblings(top, n)]
            folded = leaf(late(r))
            for left, right in steps:
                folded = sha(left + folded + right)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def result(df):
    found = merkle.manifest(df, seen={"text": F.when(F.col("n_chars") == 3, F.lit("other")).otherwise(F.col("text"))})
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("steps", [2, 4])
def test_odd_rows_equal_brute_force(spark, monkeypatch, steps):
    """Nulls everywhere, empty and long texts, repeated keys and rows, many groups; with small blocks there are several tiers of both trees."""
    monkeypatch.setattr(merkle, "STEPS", steps)
    monkeypatch.setattr(merkle, "BLOCK", 8**steps)
    texts = ["Abc", None, "", "é" * 9000]
    rows = [(i % 300 if i % 9 else None, "s" if i % 5 else None, ["en", None, "", "é", "zz"][i % 5] if i < 700 else f"l{i % 70}", i % 7, texts[i % 4]) for i in range(900)]
    df = spark.createDataFrame([(*r, 1, "t", "k", 2) for r in rows], SCHEMA)
    late = lambda r: (*r[:4], "other" if r[3] == 3 else r[4])
    assert result(df) == brute(rows, late)


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(5, None, None, None, "x", 1, "t", "k", 2)], SCHEMA)
    assert result(df) == brute([(5, None, None, None, "x")], lambda r: r)
    assert result(df.limit(0)) == []


def test_whole_table_equals_sql(spark):
    assert compare(entry.queries()["op13_merkle_manifest"](spark, DATA), connect(DATA), entry.oracle_sql()["op13_merkle_manifest"]) is None
