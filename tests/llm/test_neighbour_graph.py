import numpy as np

import __spark_entry__ as entry
from fleetlens.llm import neighbour_graph


def brute(rows, k=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in np.flatnonzero(ids % 100 == 0):
        away = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, away)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(away[j])) for j in order]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_on_the_whole_table(spark):
    data = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    got, want = by_query(entry.queries()["op8_nearest_neighbours"](spark, data)), brute(rows)
    assert set(got) == set(want) and recall(got, want) >= 0.95
    place = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (x[1], x[0])) and len(found) == 10
        assert all(abs(s - np.sqrt(((place[q] - place[i]) ** 2).sum())) < 1e-12 for i, s in found)


def test_odd_rows(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.standard_normal(6).round(1).tolist()) for i in range(400)] + [(1000 + i, [0.5] * 6) for i in range(120)] + [(3000, [1e300, 0.0, 0.0, 0.0, 0.0, 1.0])]
    bad = [(5000, None), (5100, [0.0] * 6), (5200, [1.0, None] * 3), (5300, [float("nan")] * 6), (None, [1.0] * 6), (5400, [1.0] * 5)]
    schema = "vec_id long, embedding array<double>, score int, id string, place string"
    df = spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows + bad + rows[:3]], schema)
    got, want = by_query(neighbour_graph.nearest(df.where("vec_id is null or vec_id != 3000"))), brute(rows[:-1])
    assert set(got) == set(want) and recall(got, want) >= 0.95
    assert got[1000] == [(1000 + i, 0.0) for i in range(1, 11)] and got[1100][:10] == [(1000 + i, 0.0) for i in range(10)]
    assert neighbour_graph.nearest(df.limit(0)).count() == 0
    few = by_query(neighbour_graph.nearest(df.where("vec_id in (0, 3, 100)")))
    assert {q: {i for i, _ in f} for q, f in few.items()} == {0: {3, 100}, 100: {0, 3}}
    assert neighbour_graph.nearest(df.where("vec_id = 100")).count() == 0


def test_an_outlier_leaves_the_others_their_distances(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.standard_normal(6).round(1).tolist()) for i in range(400)] + [(1000 + i, [0.5] * 6) for i in range(120)]
    for great in (1e6, 1e8, 1e300):
        whole = [*rows, (3000, [great, 0.0, 0.0, 0.0, 0.0, 1.0])]
        got, want = by_query(neighbour_graph.nearest(spark.createDataFrame(whole, "vec_id long, embedding array<double>"))), brute(whole)
        assert set(got) == set(want) and recall(got, want) >= 0.95, great
        assert got[1000] == [(1000 + i, 0.0) for i in range(1, 11)]
