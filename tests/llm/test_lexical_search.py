import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from fleetlens.llm import lexical_search
from tests.oracle_check import compare, connect

DATA = "/root/testdata/sf0.001"
DOCS, ITEMS = "doc_id long, text string, key string, score long, n int", "item_id long, text string, item string, term string, rank int"


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, c, sum(c.values())) for d, c in bags if c]
    total, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in asked.items():
        scored = []
        for d, c, n in bags:
            m = 10 + 90 * n * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, (d is not None, d or 0), d))
        out += [(i, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scored, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=str)


def result(spark, docs, items):
    found = lexical_search.search(spark.createDataFrame([(*d, "k", 1, 2) for d in docs], DOCS), spark.createDataFrame([(*i, "i", "t", 3) for i in items], ITEMS))
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def tables():
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "Straße", "中文", "A1"]
    text = lambda n: r.choice([" ", ", ", "\n"]).join(r.choices(words, weights=[64 - i for i in range(64)], k=n))
    docs = [(i, text(r.randrange(1, 40))) for i in range(300)]
    docs += [(i + 1000, docs[7][1]) for i in range(40)] + [(7, docs[7][1]), (7, "w1 w2"), (None, docs[3][1]), (None, None), (2000, None), (2001, ""), (2002, " ,;"), (2003, text(30_000))]
    items = [(i, text(r.randrange(1, 15))) for i in range(20)] + [(3, text(4)), (None, "w5 w6"), (50, docs[7][1]), (51, None), (52, ""), (53, "nowhere to be found")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows_equal_brute_force(spark, monkeypatch, tables, small):
    """Nulls, ties of many copies, repeated keys and items, a long text; small shards, blocks and pieces force their seams."""
    if small:
        for name, value in {"VOCABULARY": 20, "SHARD": 200, "FIRST": 1, "STEP": 2, "PIECE": 64}.items():
            monkeypatch.setattr(lexical_search, name, value)
    assert result(spark, *tables) == brute(*tables)


def test_empty_tables(spark):
    assert result(spark, [], [(1, "a")]) == result(spark, [(1, "a")], []) == result(spark, [(1, None)], [(1, "a")]) == []


def test_reading_in_step_ends_with_final_scores():
    r = np.random.default_rng(5)
    for k in (1, 3, 10):
        for _ in range(40):
            lists = []
            for _ in range(r.integers(1, 8)):
                who = r.permutation(60)[:r.integers(1, 60)]
                lists.append((who, -np.sort(-r.integers(0, 6, len(who)))))
            whole = np.zeros(60, np.int64)
            for who, impact in lists:
                whole[who] += impact
            kth = max(1, np.sort(whole)[-k])
            got = lexical_search.read_lists(lists, 60, k, 0)
            assert np.array_equal(got[whole >= kth], whole[whole >= kth])
            assert (got[whole < kth] < kth).all()


def test_whole_table_equals_sql(spark):
    assert compare(entry.queries()["op11_lexical_search"](spark, DATA), connect(DATA), entry.oracle_sql()["op11_lexical_search"]) is None
