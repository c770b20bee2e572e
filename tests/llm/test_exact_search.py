import numpy as np
import pytest

import __spark_entry__ as entry
from fleetlens.llm import exact_search
from tests.oracle_check import compare, connect


def brute(rows, k=10, scale=1024):
    seen = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            seen[i] = [int(np.floor(scale * x)) for x in v] if i not in seen or v < seen[i][0] else seen[i]
    out = set()
    for q in seen:
        if q % 100 == 0:
            best = sorted(((-sum(a * b for a, b in zip(seen[q], seen[i], strict=True)), i) for i in seen if i != q))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    data = f"/root/testdata/{sf}"
    assert compare(entry.queries()["op9_exact_top_k"](spark, data), connect(data), entry.oracle_sql()["op9_exact_top_k"]) is None


@pytest.mark.parametrize("annulus", [512, 7])
def test_odd_rows_equal_brute_force(spark, annulus):
    """Clusters, one vector many times, ties, zero vectors, large norms, nulls and non-finite components."""
    r = np.random.default_rng(3)
    rows = [(i, (r.standard_normal(4) * r.choice([0.1, 1, 30])).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0, 0.0, -1.0, 0.5]) for i in range(150)] + [(600 + i, [0.0] * 4) for i in range(20)]
    rows += [(2000, None), (2100, [1.0, None, 2.0, 3.0]), (2200, [float("nan"), 1.0, 1.0, 1.0]), (2300, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (-100, [2.0, 1.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id long, embedding array<double>, score int, block string")
    assert {tuple(x) for x in exact_search.top_products(df, annulus=annulus, query_block=3).collect()} == brute(rows)
    assert exact_search.top_products(df.limit(0)).count() == 0
    few = df.where("vec_id in (0, 100, 5)")
    assert exact_search.top_products(few).count() == 4


def test_bounds_hold():
    r = np.random.default_rng(0)
    for _ in range(50):
        pivot, v, q = r.integers(-50, 50, 6), r.integers(-50, 50, (9, 6)), r.integers(-50, 50, (5, 6))
        away = np.sqrt(((v - pivot) ** 2).sum(1))
        assert (exact_search.reach(q, pivot, away.min(), away.max(), float((v * v).sum(1).max()))[:, None] >= q @ v.T).all()
