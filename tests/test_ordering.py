"""Blocked windows and rank selection must equal the plain computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetlens.ordering import Ordered, order_blocks, with_index
from fleetlens.quantiles import cumulative_counts, exact_quantiles, summarize


@pytest.fixture
def skewed(events):
    # one key holds well over a third of the rows
    return events.select(
        "event_id", "ts", F.when(F.col("user_id") < 9, "hot").otherwise(F.col("user_id").cast("string")).alias("key"),
        F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("value")).alias("x"),
    )


def columns(df, blocks):
    return (
        Ordered(df, ["key"], ["ts", "event_id"], blocks)
        .row_number("rn").lag("x", 1, "l1").lag("x", 3, "l3").lead("x", "nx")
        .running_sum("x", "run").total("sum", "x", "s").total("count", "x", "n").total("max", "x", "m")
        .frame().orderBy("event_id").toPandas()
    )


def test_blocked_equals_plain(spark, skewed):
    blocks = order_blocks(skewed, "ts", rows_per_block=60)
    assert len(blocks.cuts) > 10
    plain = columns(skewed, order_blocks(skewed, "ts", rows_per_block=10**9))
    split = columns(skewed, blocks)
    pd.testing.assert_frame_equal(plain, split, check_dtype=False)


def test_index_is_dense_and_ordered(spark, skewed):
    out = with_index(skewed, ["ts", "event_id"], total="n", blocks=order_blocks(skewed, "ts", rows_per_block=70))
    pdf = out.orderBy("idx").toPandas()
    assert pdf.idx.tolist() == list(range(len(pdf)))
    assert pdf.ts.is_monotonic_increasing
    assert (pdf.n == len(pdf)).all()


def test_exact_quantiles(spark, skewed):
    named = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = exact_quantiles(skewed, ["key"], "x", named, order_blocks(skewed, "x", rows_per_block=50))
    got = got.toPandas().set_index("key").sort_index()
    want = skewed.toPandas().dropna().groupby("key").x.quantile(list(named.values())).unstack().sort_index()
    np.testing.assert_allclose(got[list(named)].values, want.values, rtol=1e-12)


def test_summarize_matches_both_ways(spark, skewed):
    args = ({"n": F.count(F.lit(1)), "mean": F.avg("x")}, {"med": ("x", 0.5), "p90": ("x", 0.9)})
    for keys in ([], ["key"]):
        one = summarize(skewed, keys, *args).toPandas()
        many = summarize(skewed, keys, *args, blocks={"x": order_blocks(skewed, "x", rows_per_block=40)}).toPandas()
        order = keys or ["n"]
        pd.testing.assert_frame_equal(one.sort_values(order, ignore_index=True), many.sort_values(order, ignore_index=True))


def test_cumulative_counts(spark, skewed):
    got = cumulative_counts(skewed.filter("x is not null"), ["key"], "x", {"c": F.lit(1)},
                            order_blocks(skewed, "x", rows_per_block=40)).toPandas()
    raw = skewed.toPandas().dropna()
    for key, grp in got.groupby("key"):
        values = raw[raw.key == key].x
        for row in grp.itertuples():
            assert row.cum_c == (values <= row.x).sum()
            assert row.all_c == len(values)


def test_kth_of_prefixes_equals_sorting():
    from fleetlens.quantiles import kth_of_prefixes

    r = np.random.default_rng(6)
    for top in (1, 2, 40, 1000):
        ranks, weights = r.integers(0, top, 300), r.integers(1, 5, 300)
        ends = np.repeat(np.arange(1, 301, 7), 5)
        k = np.array([r.integers(0, weights[:e].sum()) for e in ends])
        want = [np.sort(np.repeat(ranks[:e], weights[:e]))[i] for e, i in zip(ends, k, strict=True)]
        assert kth_of_prefixes(ranks, weights, ends, k).tolist() == want


def ordered(df, blocks):
    return (Ordered(df, ["key"], ["ts", "event_id"], blocks).row_number("rn").lag("x", 2, "l2").lead("x", "nx").running_sum("x", "run")
            .total("count", "x", "n").frame())


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_that_fit_a_block_take_the_plain_window(spark, skewed):
    rows = skewed.filter("key <> 'hot'")
    blocks = order_blocks(rows, "ts", rows_per_block=150)
    assert len(blocks.cuts) > 1
    for known in (blocks, blocks.settle(rows, ["key"])):
        out = ordered(rows, known)
        assert "Join" not in plan(out)
        pd.testing.assert_frame_equal(out.orderBy("event_id").toPandas(), ordered(rows, order_blocks(rows, "ts", 10**9)).orderBy("event_id").toPandas())
    assert blocks.settle(rows, ["key"]).fits(["day", "key"]) and not blocks.settle(skewed, ["key"]).fits(["key"])


def test_long_keys_that_hold_most_rows_and_null_keys(spark, skewed):
    for key in (F.when(F.col("event_id") % 9 != 0, "hot").otherwise(F.col("key")), F.when(F.col("key") != "hot", F.col("key"))):
        rows = skewed.withColumn("key", key)
        got = ordered(rows, order_blocks(rows, "ts", rows_per_block=60))
        assert "Join" in plan(got)
        want = ordered(rows, order_blocks(rows, "ts", 10**9))
        pd.testing.assert_frame_equal(got.orderBy("event_id").toPandas(), want.orderBy("event_id").toPandas(), check_dtype=False)
