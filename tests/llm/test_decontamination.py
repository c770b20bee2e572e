import hashlib
import random
import re

import pytest

import __spark_entry__ as entry
from fleetlens.llm import decontamination
from tests.oracle_check import compare, connect

DATA = "/root/testdata/sf0.001"
DOCS, ITEMS = "doc_id long, text string, words string, hash long, at int, named string, spans int", "item_id long, text string, items string, window int"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(WORD, lower)


def hits(text, items, window=10):
    own, hit, found = words(text), set(), set()
    for i, t in items:
        want = words(t)
        size = min(window, len(want))
        runs = {tuple(want[s:s + size]) for s in range(len(want) - size + 1)} if want and i is not None else set()
        for s in range(len(own) - size + 1):
            if tuple(own[s:s + size]) in runs:
                hit.update(range(s, s + size))
                found.add(str(i))
    return len(own), hit, sorted(found)


def brute(docs, items):
    return sorted(({(d, hashlib.sha256((t or "").encode()).hexdigest(), n, len(hit), tuple(found)) for d, t in docs for n, hit, found in [hits(t, items)]}), key=str)


@pytest.fixture(scope="module")
def tables():
    r = random.Random(8)
    text = lambda n: " ".join(r.choices(["a", "B", "é", "7", "dd"], k=n))
    items = [(i, text(r.randrange(8, 25))) for i in range(30)] + [(40, "B é"), (41, "zz"), (42, "q r s"), (42, "r s t"), (None, "never"), (43, None), (44, " ,")]
    items += [(45, items[0][1]), (46, items[0][1] + " a")]
    docs = [(i, text(r.randrange(0, 60)) + ". " + (items[i % 39][1] or "") + ",\n" + text(r.randrange(0, 20))) for i in range(80)]
    docs += [(7, docs[7][1]), (7, "other zz"), (None, docs[3][1]), (None, None), (90, None), (91, ""), (92, "Q,r;S t"), (93, "never x"), (94, "x " * 20_000 + (items[2][1]))]
    return docs, items


@pytest.mark.parametrize("block", [200_000, 40])
def test_odd_rows_equal_brute_force(spark, monkeypatch, tables, block):
    """Nulls, short items, shared windows, repeated keys and rows, a long text; a small block forces several hash sets."""
    monkeypatch.setattr(decontamination, "BROADCAST", block)
    docs, items = tables
    df, test = spark.createDataFrame([(*d, "w", 1, 2, "k", 3) for d in docs], DOCS), spark.createDataFrame([(*i, "x", 3) for i in items], ITEMS)
    got = decontamination.contamination(df, test)
    assert sorted((tuple([*r[:4], tuple(r[4])]) for r in got.select("doc_id", "digest", "n_words", "n_hit", "items").collect()), key=str) == brute(docs, items)


def test_spans_and_documents_go(spark, tables):
    docs, items = tables
    df, test = spark.createDataFrame([(*d, "w", 1, 2, "k", 3) for d in docs], DOCS), spark.createDataFrame([(*i, "x", 3) for i in items], ITEMS)

    def cut(text):
        _, hit, _ = hits(text, items)
        found = list(re.finditer(WORD, text or ""))
        if not hit:
            return text
        ends = [m.start() for m in found[1:]] + [len(text)]
        return text[:found[0].start()] + "".join(text[m.start():e] for n, (m, e) in enumerate(zip(found, ends, strict=True)) if n not in hit)

    got = decontamination.decontaminated(df, test)
    assert got.columns == df.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(((d, cut(t), "w", 1, 2, "k", 3) for d, t in docs), key=str)
    kept = decontamination.decontaminated(df, test, whole=True)
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted(((*d, "w", 1, 2, "k", 3) for d in docs if not hits(d[1], items)[1]), key=str)


def test_empty_tables(spark):
    df, test = spark.createDataFrame([(1, "a b", "w", 1, 2, "k", 3)], DOCS), spark.createDataFrame([(1, "a", "x", 3)], ITEMS)
    assert decontamination.contamination(df.limit(0), test).collect() == []
    clean = decontamination.contamination(df, test.limit(0)).first()
    assert (clean["n_words"], clean["n_hit"], clean["items"]) == (2, 0, [])


def test_whole_table_equals_sql(spark):
    assert compare(entry.queries()["op12_decontamination"](spark, DATA), connect(DATA), entry.oracle_sql()["op12_decontamination"]) is None
