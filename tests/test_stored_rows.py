"""Rows behind expensive plans are written once where a query reads them again, and many blocks give the rows of one."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fleetlens.ordering import BLOCK_ROWS_CONF

SMALL = {"l03_stratified_errors": 500, "n06_snapshot_quantiles": 300, "p04_cooldown_and_data_guards": 300, "o16_residual_alarms": 300}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """1,500 events of 12 users over some days."""
    path = tmp_path_factory.mktemp("events")
    i = F.col("id")
    spark.range(1500).select(
        i.alias("event_id"), (F.to_timestamp(F.lit("2024-03-01")) + F.make_dt_interval(mins=(i * 7).cast("int"))).alias("ts"), (i % 12).alias("user_id"),
        F.when(i % 5 == 0, "error").otherwise("view").alias("event_type"), (20 + (i * 37) % 90 + F.when(i > 700, (i * 7919) % 900).otherwise(0) + i % 7 / 8).cast("double").alias("value"),
        F.lit("{}").alias("props")).write.parquet(f"{path}/events.parquet")
    return str(path)


def _plain(rows):
    return sorted((tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", SMALL)
def test_scored_rows_are_stored(spark, folder, name):
    whole = _plain(entry.queries()[name](spark, folder).collect())
    spark.conf.set(BLOCK_ROWS_CONF, str(SMALL[name]))
    try:
        found = entry.queries()[name](spark, folder)
        files, rows = found.inputFiles(), _plain(found.collect())
    finally:
        spark.conf.unset(BLOCK_ROWS_CONF)
    assert files and not any("events.parquet" in f for f in files), "computed again from the events"
    assert rows == whole and rows


def test_rescored_and_disturbed_rows_are_stored(spark, folder, monkeypatch):
    from fleetlens.operators import drift_detect
    from fleetlens.plans import drift_queries, evaluation_queries
    from fleetlens.session import materialize

    labels = []

    def recorded(df, label):
        labels.append(label)
        return materialize(df, label)

    for module in (drift_detect, drift_queries, evaluation_queries):
        monkeypatch.setattr(module, "materialize", recorded, raising=False)
    entry.queries()["m10_scenario_benchmark"](spark, folder)
    assert labels == ["rescored"]
    entry.queries()["o18_drift_summary"](spark, folder)
    assert {"disturbed", "pane-counts"} <= set(labels)


def test_blocks_of_several_detectors_and_a_null_key(spark):
    """Both detectors fold a block in one round; a null key is folded like others."""
    from fleetlens.operators.sequential import PageHinkley, SplitWindow, detect
    from fleetlens.ordering import OrderBlocks, order_blocks

    detectors = (PageHinkley(threshold=12.0), SplitWindow(max_window=60, min_window=20, min_gain=2.0, cooldown=10))
    rows = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.col("id").alias("at"),
                                   ((F.col("id") * 37) % 50 + F.when(F.col("id") % 400 > 250, 120).otherwise(0)).cast("double").alias("e"))
    whole = detect(rows, ["k"], ["at"], "e", detectors, False, OrderBlocks("at"))
    cut = detect(rows, ["k"], ["at"], "e", detectors, False, order_blocks(rows, "at", 150))
    assert _plain(cut.collect()) == _plain(whole.collect()) and cut.count() == 1800
    assert cut.where("in_drift = 1").select("detector").distinct().count() == 2
