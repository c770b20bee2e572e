import pytest

import corpus_pipeline
from fleetlens.llm import toxicity
from fleetlens.session import materialize
from tests.llm.test_line_dedup import brute_by_blocks
from tests.llm.test_ngram_join import brute as classes
from tests.llm.test_substring_dedup import brute as cuts

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and what comes out."""
    docs, found = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, DATA), name)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        found[name] = (docs, out)
        docs = out
    return found


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.fitted(spark, before, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert texts(after) == {r["doc_id"]: t for r in toxicity.score(before, model).collect() if not r["predicted"] for t in [texts(before)[r["doc_id"]]]}


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    rows = sorted(texts(before).items())
    want = {k: n for k, _, n, _ in brute_by_blocks(rows)}
    got = texts(after)
    for k, t in rows:
        assert (k in got) or want[k]
        if k in got:
            assert len(t.split("\n")) - len(got[k].split("\n")) == want[k]
        else:
            assert sum(x.strip(" ") != "" for x in t.split("\n")) == want[k]


def test_ngram_join(stages):
    before, after = stages["ngram_jaccard_join"]
    assert texts(after) == {k: t for k, t in texts(before).items() if k in {c for c, _ in classes(texts(before)).values()}}


def test_substring_dedup(stages):
    before, after = stages["substring_dedup"]
    rows = sorted(texts(before).items())
    got = texts(after)
    for k, n, removed, _ in cuts(rows):
        assert (k not in got) == (removed == n and n > 0)
        assert k not in got or (got[k] == dict(rows)[k] if not removed else len(got[k].split()) == n - removed)
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_packing(stages):
    before, after = stages["best_fit_packing"]
    assert {r["doc_id"] for r in after.collect()} == set(texts(before))


def test_odd_rows_and_empty_tables_go_through_all_stages(spark):
    """Nulls in any column, empty and long texts, repeated rows, extra columns with clashing names; the clean, distinct document stays as it is."""
    long = " ".join(f"w{i % 4999}x{i}" for i in range(40_000))
    rows = [(1, "One clean document of its own.", "en", "s", 30), (1, "One clean document of its own.", "en", "s", 30), (None, "no key", None, None, None), (2, None, "en", "s", None),
            (3, "", None, "s", 0), (4, long, "de", None, 7), (5, long, "de", None, 7), (None, None, None, None, None), (6, "\n\n", "en", "s", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, removed string, _spans string, named int, length long, class_id string"
    df = spark.createDataFrame([(*r, "r", "s", 3, 4, "c") for r in rows], schema)
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, materialize(stage(spark, docs, DATA), name)
            if name != "best_fit_packing":
                assert docs.columns == before.columns
                found = {tuple(r)[:2] for r in docs.collect()}
                assert (1, "One clean document of its own.") in found or before.isEmpty()
                assert (4, long) in found or before.isEmpty()
        assert {r["doc_id"] for r in docs.collect()} >= ({1, 4} if not before.isEmpty() else set())
