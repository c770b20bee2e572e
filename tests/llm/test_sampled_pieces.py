import math
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from fleetlens.llm import sampled_pieces as sp

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pieces():
    return sp.pieces_of()


def every_path(pieces, text):
    """All segmentations with their probabilities, by plain recursion."""
    def go(rest):
        if not rest:
            return [((), 0.0)]
        out = []
        for end in range(1, len(rest) + 1):
            found = None if sp.SPACE in rest[:end] else pieces.pieces.get(rest[:end].replace(" ", sp.SPACE))
            if found:
                out += [((found[0], *ids), found[1] + s) for ids, s in go(rest[end:])]
            elif end == 1:
                spelt = tuple(pieces.bytes[b] for b in rest[0].encode())
                out += [((*spelt, *ids), len(spelt) * pieces.unknown + s) for ids, s in go(rest[1:])]
        return out

    paths = go(" " + text)
    total = math.log(sum(math.exp(s) for _, s in paths))
    return {ids: s - total for ids, s in paths}


@pytest.mark.parametrize("text", ["the cat", "ab\n é", "x", "▁a", "日"])
def test_samples_are_paths_with_their_probabilities(pieces, text):
    want = every_path(pieces, text)
    got = pieces.samples(text, 50, np.random.default_rng(3))
    ids = [tuple(i.tolist()) for i, _, _ in got]
    assert len(set(ids)) == len(ids) == min(50, len(want))
    assert all(abs(lp - want[i]) < 1e-5 for i, (_, lp, _) in zip(ids, got, strict=True)) and all(0 <= q <= 1 for _, _, q in got)
    assert all(pieces.decode(list(i)) == text for i in ids)


def test_draws_follow_the_probabilities(pieces):
    text, n = "the cat", 4000
    want = every_path(pieces, text)
    first, second, weight = Counter(), Counter(), Counter()
    for seed in range(n):
        got = pieces.samples(text, 3, np.random.default_rng(seed))
        a, b = (tuple(x[0].tolist()) for x in got[:2])
        first[a] += 1
        second[b] += 1
        for ids, lp, q in got:
            weight[tuple(ids.tolist())] += math.exp(lp) / q
    for ids, lp in sorted(want.items(), key=lambda x: -x[1])[:6]:
        p = math.exp(lp)
        assert abs(first[ids] / n - p) < 5 * math.sqrt(p / n)
        after = sum(math.exp(o) * p / (1 - math.exp(o)) for i, o in want.items() if i != ids)  # drawn second, without replacement
        assert abs(second[ids] / n - after) < 5 * math.sqrt(after / n)
        assert abs(weight[ids] / n - p) < 0.12 * p + 0.01  # inclusion scores make unbiased weights


def test_whole_table_round_trip(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = entry.queries()["op5_sentencepiece_sampling"](spark, SMALL).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and all(r["round_trip"] for r in rows)
    assert len({(r["doc_id"], r["ids_crc32"]) for r in rows}) == len(rows)


def test_odd_rows_do_not_depend_on_partitions(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "a" * 3000), (5, "two  spaces \n\n end "), (6, "▁ mark"), (None, "null key"), (7, "same"), (7, "same"), (8, "퟿\U0001f600 <s>")]
    df = spark.createDataFrame([(k, t, 1, [2]) for k, t in rows], "doc_id long, text string, sample int, ids array<int>")
    key = lambda r: (str(r["doc_id"]), r["sample"], r["ids"])
    one, many = (sorted((tuple(r) for r in sp.encode_samples(d).collect()), key=str) for d in (df.coalesce(1), df.repartition(7)))
    assert one == many
    texts = {r["doc_id"]: r["decoded"] for r in sp.decode_samples(sp.encode_samples(df)).collect()}
    assert texts == {k: t or "" for k, t in rows} and key
    assert sp.encode_samples(df.limit(0)).count() == 0


def test_lattices_of_many_units_are_those_of_single_ones(pieces):
    texts = ["the cat sat  on\n\n the mat", "▁a b▁ ▁", "日本語 é\U0001f600x", "internationalisation of ab1c2 http://x.y/z?q=1", " ", "x" * 47 + " " + "y" * 48]
    alone, together = sp.Pieces(None, 1.0), sp.Pieces(None, 1.0)
    together.learn([u for t in texts for u in together.units(" " + t)])
    assert together.places and not together.fresh[0]
    alone.learn = lambda units: None  # each unit by ``lattice``
    for n, t in enumerate(texts):
        a, b = (p.samples(t, 20, np.random.default_rng(n)) for p in (alone, together))
        assert [(x[0].tolist(), x[1:]) for x in a] == [(x[0].tolist(), x[1:]) for x in b]


def test_a_worker_forgets(pieces, monkeypatch):
    monkeypatch.setattr(sp, "PLACES", 300)
    p, r = sp.Pieces(None, 1.0), np.random.default_rng(4)
    for n in range(200):
        text = " ".join("".join(chr(c) for c in r.integers(97, 123, 6)) for _ in range(10))
        assert p.decode(p.samples(text, 1, np.random.default_rng(n))[0][0].tolist()) == text
        assert p.places < 900
