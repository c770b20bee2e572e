"""Scenarios that share a feature's values share its statistics."""

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import drift_detect, drift_stats, drift_windows, whatif

FEATURES = ["hour", "rain", "segment_delay_ratio", "previous_segment_run_time"]


@pytest.fixture(scope="module")
def stream(spark):
    """A reference, and rows of all scenarios, some values missing."""
    def rows(n, seed):
        return spark.range(n).select(
            F.col("id").alias("idx"), F.lit(n).cast("long").alias("n"), (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600)).alias("timestamp_utc"),
            (F.col("id") % 15 + 1).cast("int").alias("segment"), (F.col("id") % 24).cast("int").alias("hour"),
            F.when(F.col("id") % 7 != 0, F.floor(F.rand(seed) * 4) / 2).alias("rain"), F.rand(seed + 1).alias("segment_delay_ratio"),
            (F.rand(seed + 2) * 60).alias("previous_segment_run_time"), (F.rand(seed + 3) * 60).alias("actual"))
    reference = spark.createDataFrame(rows(800, 1).toPandas())
    current = spark.createDataFrame(rows(1130, 11).toPandas())
    return reference, whatif.scenario_rows(current)


def test_shared_features_are_counted_once(spark, stream, monkeypatch):
    reference, rows = stream
    long = drift_stats.feature_rows(reference, [], FEATURES)
    profile = drift_stats.numeric_profile(long)
    shared = whatif.shared_columns(FEATURES)
    assert shared["hour"] == {"BASELINE": [s for s in whatif.CATALOG if s != "BASELINE"]}
    counted, pane_counts = [], drift_detect.pane_counts

    def recorded(*args):
        counted.append(pane_counts(*args))
        return counted[-1]

    monkeypatch.setattr(drift_detect, "pane_counts", recorded)
    got = [drift_detect.window_feature_stats(r, FEATURES, profile, long, ["scenario_id"], shared=x)
           for r, x in ((rows, None), (rows, shared), (whatif.without_copies(rows, shared), shared))]
    tables = [sorted(tuple(round(v, 9) if isinstance(v, float) else v for _, v in sorted(r.asDict().items())) for r in g.collect()) for g in got]
    assert tables[0] == tables[1] == tables[2] and len(tables[0]) == 4 * 7 * len(FEATURES)
    pairs = counted[1].select("scenario_id", "feature").distinct().count()
    assert pairs < counted[0].select("scenario_id", "feature").distinct().count() == 7 * len(FEATURES)
    assert pairs == 7 * len(FEATURES) - sum(len(x) for g in shared.values() for x in g.values())


def test_a_scenario_alone_shares_nothing():
    assert whatif.shared_columns(FEATURES, [whatif.HEAVY_RAIN]) == {}
    idle = whatif.HEAVY_RAIN.at(0.0)
    assert whatif.shared_columns(["rain"], [whatif.BASELINE, idle]) == {"rain": {"BASELINE": ["HEAVY_RAIN"]}}


@pytest.mark.parametrize("n", [90, 400, 500, 777, 1130])
def test_bounds_by_panes(spark, n):
    rows = spark.range(n).select("id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("k")).select("k", F.col("id").alias("idx"), F.lit(n).cast("long").alias("n"))
    rows = rows.filter("idx % 250 <> 3 or k = 'a'")
    plain = drift_windows.window_bounds(drift_windows.sliding_windows(rows), ["k"])
    by_panes = drift_windows.pane_bounds(rows, ["k"])
    assert plain.columns == by_panes.columns and sorted(plain.collect()) == sorted(by_panes.collect())
