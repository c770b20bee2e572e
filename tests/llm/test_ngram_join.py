import random
import re

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from fleetlens.llm import common, components, ngram_join, words

SMALL = "/root/testdata/sf0.001"


def grams(text, n=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    n = min(n, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(texts, similarity=0.8):
    """(class, links) per document by comparing all pairs."""
    sets = {i: grams(t) for i, t in texts.items()}
    root, links = {i: i for i in texts}, {i: 0 for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                i, j = sorted((find(a), find(b)))
                root[j] = i
    return {i: (find(i), links[i]) for i in texts}


def got(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


def test_word_hashes_are_those_of_words():
    texts = ["a bb  ccc", "", " \n", "é x y", "a bb", "bb", "x" * 3_000_000 + " a"]
    column = pa.array(texts)
    seen = {}
    rows = []
    for part in words.hashed_words(column):
        at = part.offsets
        for d in range(len(part.counts)):
            rows.append([(part.hashes[k], part.raw[part.starts[k]:part.ends[k]].tobytes().decode()) for k in range(at[d], at[d + 1])])
    assert [[w for _, w in r] for r in rows] == [[x for x in re.split(r"[\x20\x09-\x0D]+", t) if x] for t in texts]
    for h, w in (x for r in rows for x in r):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    sliced = [len(p.counts) for p in words.hashed_words(column.slice(1, 3))]
    assert sum(sliced) == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (200, 200)] + [(1000, 1000 + i) for i in range(50)] + [(None, 3)]
    rows = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert rows == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 103: 100, **{1000 + i: 1000 for i in range(50)}}


def test_whole_table_equals_all_pairs(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert got(entry.queries()["op1_ngram_jaccard_join"](spark, SMALL)) == brute(texts)


@pytest.mark.parametrize("small", [128, 8])
def test_large_groups_equal_all_pairs(spark, small, monkeypatch):
    """Large groups of near copies, a line that all share, ties and thresholds; with small buckets, levels and block pairs are used."""
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join.in_blocks, "__defaults__", (small,))
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    line = r.choices(vocabulary, k=12)
    texts = {}
    for g in range(6):
        base = r.choices(vocabulary, k=r.randrange(60, 200))
        for _ in range(r.choice([1, 4, 60])):
            text = list(base)
            for _ in range(r.randrange(0, 5)):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            texts[len(texts)] = " ".join(line + text)
    for _ in range(60):
        texts[len(texts)] = " ".join(line + r.choices(vocabulary, k=r.randrange(5, 60)))
    for t in ("", None, "a", "a", "a b", "a b c d e", "a b c d e f", "w " * 5000):
        texts[len(texts)] = t
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, root string, size int")
    assert got(ngram_join.near_duplicates(df)) == brute(texts)
    kept = ngram_join.representatives(df)
    assert kept.schema == df.schema and {x["doc_id"] for x in kept.collect()} == {c for c, _ in brute(texts).values()}


def test_no_rows_and_null_keys(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    assert got(ngram_join.near_duplicates(df)) == {1: (1, 0)} and ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.r_[a[:900], rng.integers(0, 2**63, 100).astype(np.uint64)]
    sketches = [(np.unique(x << np.uint64(1))[:ngram_join.SKETCH] >> np.uint64(32)).astype("u4") for x in (a, b, a)]
    est = ngram_join.alike(sketches, np.array([False] * 3), np.array([0, 0]), np.array([1, 2]))
    assert abs(est[0] - 900 / 1100) < 0.2 and est[1] == 1
    assert ngram_join.runs() == 15


def group_of(**columns):
    return pa.table({"bi": [0] * len(columns["mine"]), "bj": [1] * len(columns["mine"]), **columns})


def test_blocks_that_hang_together_are_tied_by_one_edge():
    """Near copies within a block are tied by the block's own group; a pair of blocks adds what joins them and all its links."""
    tokens = np.arange(1, 101, dtype=np.uint64)
    sets = [np.delete(tokens, i).tobytes() for i in range(6)] + [np.arange(500, 600, dtype=np.uint64).tobytes()]
    found = ngram_join.exact_links(0.8)(group_of(doc=list(range(7)), mine=[0, 0, 0, 1, 1, 1, 1], copies=[1] * 7, tokens=sets))
    links = [n for n, near in zip(found["links"], found["near"], strict=True) if near is None]
    assert links == [3, 3, 3, 3, 3, 3, 0]
    assert [(d, near) for d, near in zip(found["doc"], found["near"], strict=True) if near is not None] == [(3, 0)]


def test_alike_members_tie_their_roots_once():
    sketch = np.arange(1, 65, dtype="<u4").tobytes()
    group = group_of(root=[1, 1, 1, 7, 7, 9], node=[1, 2, 3, 7, 8, 9], mine=[0, 1, 0, 1, 0, 1], size=[500] * 6, sketch=[sketch] * 6)
    found = ngram_join.linked_by_sketch(0.8)(group)
    assert sorted(zip(found["a"], found["b"], strict=True)) == [(7, 1), (9, 1)]


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000 + (7 * i) % 101, 1000 + (7 * i + 7) % 101) for i in range(101)] + [(5, None), (9999, 9999)]
    rows = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert rows == {i: 0 for i in range(401)} | {i: 1000 for i in range(1000, 1101)}


def test_rows_without_a_partner_stay_out_of_a_join(spark):
    df, others = spark.range(-1000, 20_000).selectExpr("cast(id as int) as doc", "id as slot"), spark.range(0, 20_000, 100).selectExpr("id as other")
    kept = {r["doc"] for r in common.likely_among(df, "doc", others, "other").collect()}
    assert set(range(0, 20_000, 100)) <= kept and len(kept) < 300
    assert common.likely_among(df, "doc", others.limit(0), "other").count() == 0
