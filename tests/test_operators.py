"""Operators on literal rows with known results."""

import math

import pytest
from pyspark.sql import functions as F

from fleetlens.columns import nan_to_null, resolve, round_to, with_default
from fleetlens.functions.geo import clock_seconds, haversine_km
from fleetlens.functions import labels as L
from fleetlens.operators import cleaning, evaluation, features, labels, quality, splits, topology, whatif


def one(df):
    return df.first().asDict()


def test_nan_and_defaults(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (None, 2.0)], "a double, b double")
    assert [tuple(r) for r in nan_to_null(df).collect()] == [(1.0, None), (None, 2.0)]
    assert [r.a for r in with_default(df, "a", 7.0).collect()] == [1.0, 7.0]
    assert [r.c for r in with_default(df, "c", 3).collect()] == [3, 3]
    assert resolve(df, ["x", "b"]) == "b" and resolve(df, ["x"]) is None


def test_rounding_is_half_away(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.125,), (None,)], "x double")
    assert [r[0] for r in df.select(round_to(F.col("x"), 0)).collect()] == [3.0, -3.0, 0.0, None]
    assert [r[0] for r in df.select(round_to(F.col("x"), 2)).collect()] == [2.5, -2.5, 0.13, None]


RUN = "trip_id double, deviceid double, direction double, segment double, date string, start_time string, run_time_in_seconds double"


def test_run_time_cleaning(spark):
    raw = spark.createDataFrame([
        (1.0, 262.0, 1.0, 1.0, "2021-10-01", "06:30:00", 120.0), (1.0, 262.0, 1.0, 2.0, "2021-10-01", "06:35:00", -10.0),
        (1.0, 262.0, 1.0, 3.0, "invalid_date", "06:40:00", 120.0), (2.0, 262.0, 2.0, 1.0, "2021-10-01", "07:30:00", 150.0)], RUN)
    rows = cleaning.clean_run_times(raw).orderBy("trip_id").collect()
    assert [(r.trip_id, r.deviceid, r.direction, r.run_time_in_seconds, r.route_id) for r in rows] == [
        ("1", "262", 1, 120.0, "654"), ("2", "262", 2, 150.0, "654")]
    trail = {r.stage: (r.records_before, r.records_removed, r.records_remaining)
             for r in cleaning.audit_trail(raw, cleaning.run_time_rules()).collect()}
    assert trail == {"duplicate_removal": (4, 0, 4), "missing_attributes_filter": (4, 0, 4),
                     "timestamp_parsing": (4, 1, 3), "run_time_bounds": (3, 1, 2)}


def test_audit_counts_copies_once(spark):
    row = (1.0, 262.0, 1.0, 1.0, "2021-10-01", "06:30:00", 9999.0)
    trail = cleaning.audit_trail(spark.createDataFrame([row] * 5, RUN), cleaning.run_time_rules()).orderBy("stage_number").collect()
    assert [r.records_removed for r in trail] == [4, 0, 0, 1] and trail[-1].records_remaining == 0


def test_position_cleaning(spark):
    rows = spark.createDataFrame([("2023-01-01 10:00:00", 53.3498, -6.26, 25.0, "r", "t", "s"), ("2023-01-01 10:00:00", 12.0, -6.26, 30.0, "r", "t", "s"),
                                  ("2023-01-01 10:00:00", 53.351, -6.26, 150.0, "r", "t", "s")],
                                 "timestamp_utc string, latitude double, longitude double, current_speed_kmh double, route_id string, trip_id string, stop_id string")
    rules = cleaning.position_rules((53.05, 53.65), (-6.65, -6.0), (0.0, 100.0))
    assert cleaning.apply_rules(rows, rules).count() == 1


def test_validator(spark):
    df = spark.createDataFrame([(53.35, -6.26, 30.0), (53.36, -6.25, -20.0)], "lat double, lon double, delay double")
    coords = quality.coordinate_violations("lat", "lon", (53.0, 54.0), (-7.0, -6.0))
    verdict = lambda d: one(quality.validation_verdict(d, coords, F.lit(False), quality.outside("delay", -3600, 7200)))
    assert verdict(df)["is_valid"] == 1
    bad = df.union(spark.createDataFrame([(12.34, -6.2, 99999.0)], df.schema))
    got = verdict(bad)
    assert (got["out_of_bounds_coords_count"], got["invalid_delay_count"], got["is_valid"]) == (1, 1, 0)
    assert verdict(df.limit(0))["is_valid"] == 0


def test_distance_and_clock(spark):
    df = spark.createDataFrame([(53.3475, -6.2592, 53.4264, -6.2499, "25:10:07", " 06:05 ")], "a double, b double, c double, d double, t string, u string")
    km, sec, short = df.select(haversine_km(*[F.col(c) for c in "abcd"]), clock_seconds(F.col("t")), clock_seconds(F.col("u"))).first()
    assert 8.5 < km < 10.5 and sec == 90607 and short == 21900


def test_labels_by_next_record(spark):
    df = spark.createDataFrame([("T1", "2023-01-01 10:00:00"), ("T1", "2023-01-01 10:01:30"), ("T1", "2023-01-01 10:03:00")], "trip_id string, t string")
    out = labels.time_to_next_record(df.withColumn("timestamp_utc", F.col("t").cast("timestamp")), ["timestamp_utc"])
    assert [r[0] for r in labels.valid_labels(out).select("eta_to_next_stop_sec").collect()] == [90.0, 90.0]
    assert one(labels.rejections(out))["missing_label"] == 1


def test_label_equal_to_minimum_is_counted_and_kept(spark):
    df = spark.createDataFrame([(1.0,), (0.5,), (3600.0,), (3601.0,), (None,)], "eta_to_next_stop_sec double")
    assert one(labels.rejections(df)) == {"total_rows": 5, "missing_label": 1, "too_small": 2, "too_large": 1, "valid_rows": 2}


def test_label_distribution(spark):
    got = one(labels.label_distribution(spark.createDataFrame([(120.0,), (150.0,), (180.0,)], "eta_to_next_stop_sec double")))
    assert [got[f"{p}_sec"] for p in ("p25", "p50", "p75", "p90", "p95", "p99")] == pytest.approx([135, 150, 165, 174, 177, 179.4])
    empty = one(labels.label_distribution(spark.createDataFrame([], "eta_to_next_stop_sec double")))
    assert empty["count"] == 0 and empty["p99_sec"] == 0


def trip(spark):
    rows = [("1", "262", 1, s, t, x, 0.5) for s, t, x in ((1, "06:30", 120.0), (2, "06:35", 180.0), (3, "06:40", 150.0))]
    df = spark.createDataFrame(rows, "trip_id string, deviceid string, direction int, segment int, t string, run_time_in_seconds double, length double")
    return df.withColumn("timestamp_utc", F.concat(F.lit("2021-10-04 "), "t").cast("timestamp")).drop("t")


def test_run_time_features(spark):
    rows = features.run_time_features(trip(spark)).orderBy("segment").collect()
    assert [r.previous_segment_run_time for r in rows] == [120.0, 120.0, 180.0]
    assert [r.cumulative_trip_time_sec for r in rows] == [0.0, 120.0, 240.0]
    assert [r.segments_remaining for r in rows] == [2, 1, 0]
    assert rows[2].rolling_prev_segment_mean == pytest.approx(140.0)
    assert rows[2].rolling_prev_segment_std == pytest.approx(math.sqrt(1200))
    assert rows[0].rolling_prev_segment_std == 0.0 and rows[0].temperature_2m == 0.0
    assert rows[0].day_of_week == 0 and rows[2].congestion_proxy == 0
    assert rows[1].segment_delay_ratio == pytest.approx(120 / 180)


def test_leakage_names():
    features.check_feature_names(["hour"], required=["hour"])
    for bad in ("eta_to_next_stop_sec", "future_dwell_time", "My_Next_Arrival_x", " Target "):
        with pytest.raises(features.LeakageError):
            features.check_feature_names(["hour", bad])
    with pytest.raises(ValueError):
        features.check_feature_names(["hour"], required=["minute"])


def test_chronological_split(spark):
    df = spark.range(100).select("id", F.timestamp_seconds(F.col("id") * 86400).alias("t"))
    out = splits.chronological_split(df, ["t"]).groupBy("split").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).collect()
    by = {r.split: r for r in out}
    assert {k: v.n for k, v in by.items()} == {"train": 70, "validation": 15, "stream": 15}
    assert by["train"].b < by["validation"].a and by["validation"].b < by["stream"].a


def test_candidate_dataset(spark):
    stream = spark.range(1000).select("id", F.timestamp_seconds("id").alias("timestamp_utc"), F.rand(1).alias("actual_eta_sec"))
    history = spark.range(5).select((-F.col("id") - 1).alias("id"), F.timestamp_seconds(-F.col("id") - 1).alias("timestamp_utc"), F.lit(1.0).alias("eta_to_next_stop_sec"))
    train, recent = splits.candidate_dataset(history, stream, ["timestamp_utc"])
    assert train.count() == 805 and recent.count() == 200
    assert recent.agg(F.min("timestamp_utc")).first()[0] > train.agg(F.max("timestamp_utc")).first()[0]
    manifest = one(splits.provenance(train, recent, recent, ["id"], ["id"]))
    assert manifest["is_disjoint"] == 1 and manifest["train_rows"] == 805


def test_table_hash_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "x int, y string")
    assert one(splits.table_hash(df)) == one(splits.table_hash(df.orderBy(F.desc("x"))))
    changed = df.withColumn("y", F.coalesce("y", F.lit("")))
    assert one(splits.table_hash(df)) != one(splits.table_hash(changed))


def test_metrics(spark):
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 190.0), (300.0, 310.0), (400.0, 390.0), (500.0, 520.0)], "y double, p double")
    got = one(evaluation.regression_metrics(df, "y", "p"))
    assert got["mae_sec"] == 12 and got["median_ae_sec"] == 10 and got["r2"] > 0.95 and got["non_positive_count"] == 0
    edge = spark.createDataFrame([(5.0, 3600.0), (20.0, 0.0)], "y double, p double")
    assert one(evaluation.regression_metrics(edge, "y", "p"))["excessive_count"] == 1
    assert one(evaluation.regression_metrics(edge, "y", "p", gate_variant=True))["excessive_count"] == 0


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (5.0,), (101.0,), (-1.0,)], "x double")
    got = [r[0] for r in df.select(L.right_closed(F.col("x"), *L.PRECIPITATION_TIERS)).collect()]
    assert got == ["No Rain (0 mm)", "Light Rain (0-1 mm)", "Light Rain (0-1 mm)", "Moderate Rain (1-5 mm)", None, None]


def test_weather_labels(spark):
    df = spark.createDataFrame([(0,), (2,), (48,), (82,), (99,), (71,), (None,)], "c int")
    assert [r[0] for r in df.select(L.weather_label(F.col("c"))).collect()] == [
        "Clear Sky", "Mainly Clear / Overcast", "Fog", "Rain / Shower", "Thunderstorm", "Weather Code 71", "Clear Sky"]


def test_schedule_days_and_speed(spark):
    rows = spark.createDataFrame([("t", 1, "23:59:00", 1.0), ("t", 2, "24:01:00", 1.0), ("t", 3, "24:01:00", 0.0)],
                                 "trip_id string, stop_sequence int, arrival_time string, segment_distance_km double")
    rows = rows.withColumns({"block_id": F.lit("x_17"), "stop_lat": F.lit(1.0), "stop_lon": F.lit(2.0)})
    out = topology.scheduled_trajectory(topology.expand_service_days(rows, "2023-01-01", "2023-01-02"), ["timestamp_utc", "stop_sequence"])
    got = out.filter("service_date = '2023-01-01'").orderBy("stop_sequence").collect()
    assert [r.segment_time_sec for r in got] == [120.0, 0.0, None]
    assert [r.current_speed_kmh for r in got] == [30.0, 25.0, 25.0]
    assert got[0].vehicle_id == "BUS_17" and out.count() == 6


def test_weather_join_without_table(spark):
    out = topology.hourly_weather_join(trip(spark), None)
    assert out.filter("rain is not null").count() == 0 and dict(out.dtypes)["rain"] == "double"


def test_route_topology(spark):
    stops = spark.createDataFrame([("a", "Kandy-Digana", 654), ("b", "Digana-Kandy", 654), ("c", "Kandy-Digana", 654), ("d", None, 654)],
                                  "stop_id string, direction string, route_id int")
    got = {r.stop_id: (r.direction_id, r.stop_sequence) for r in topology.route_topology(stops).collect()}
    assert got == {"a": (1, 1), "b": (2, 1), "c": (1, 2), "d": (1, 3)}


def scenario_row(spark, hour="08:30", segment=8):
    df = spark.createDataFrame([(segment, 100.0, 1.0, 120.0, 120.0, 50.0, 0.0, 0.0, 70.0, 0, 0, 0)],
                               "segment int, actual double, segment_delay_ratio double, previous_segment_run_time double, rolling_prev_segment_mean double, "
                               "cumulative_trip_time_sec double, precipitation double, rain double, relative_humidity_2m double, weather_code int, is_peak_period int, congestion_proxy int")
    return df.withColumn("timestamp_utc", F.lit(f"2022-01-03 {hour}:00").cast("timestamp"))


def test_scenarios(spark):
    rush = one(whatif.RUSH_HOUR.apply(scenario_row(spark)))
    assert (rush["actual"], rush["segment_delay_ratio"], rush["previous_segment_run_time"], rush["is_peak_period"]) == (152.5, 1.45, 151.5, 1)
    assert one(whatif.RUSH_HOUR.apply(scenario_row(spark, "12:00")))["actual"] == 100.0
    rain = one(whatif.HEAVY_RAIN.apply(scenario_row(spark)))
    assert (rain["precipitation"], rain["rain"], rain["relative_humidity_2m"], rain["weather_code"], rain["actual"]) == (12.8, 11.2, 96.0, 65, 128.0)
    incident = one(whatif.ROAD_INCIDENT.apply(scenario_row(spark)))
    assert incident["actual"] == pytest.approx(287.0) and incident["disturbance_applied"]
    assert one(whatif.ROAD_INCIDENT.apply(scenario_row(spark, segment=5)))["actual"] == 100.0
    dwell = one(whatif.DWELL_SURGE.apply(scenario_row(spark)))
    assert (dwell["actual"], dwell["previous_segment_run_time"], dwell["cumulative_trip_time_sec"]) == (148.75, 150.0, 117.5)
    assert one(whatif.BASELINE.apply(scenario_row(spark)))["disturbance_applied"] is False
    assert one(whatif.HEAVY_RAIN.at(0.0).apply(scenario_row(spark)))["actual"] == 100.0
    with pytest.raises(ValueError):
        whatif.HEAVY_RAIN.at(1.5)


def test_scenario_time_range_and_monotonicity(spark):
    from dataclasses import replace
    gated = replace(whatif.CONGESTION_SURGE, start="2022-01-03 08:00:00", end="2022-01-03 10:00:00")
    assert [one(gated.apply(scenario_row(spark, h)))["disturbance_applied"] for h in ("08:30", "07:30", "10:30")] == [True, False, False]
    values = [one(whatif.COMBINED_DISRUPTION.at(i).apply(scenario_row(spark)))["actual"] for i in (0.2, 0.5, 0.9)]
    assert values == sorted(values) and values[0] > 100.0


def test_all_scenarios_equal_one_by_one(spark):
    rows = scenario_row(spark).unionByName(scenario_row(spark, "17:00", 3))
    together = {(r.scenario_id, r.segment): r.asDict() for r in whatif.scenario_rows(rows).collect()}
    for name, scenario in whatif.CATALOG.items():
        for r in scenario.apply(rows).collect():
            got = together[(name, r.segment)]
            assert {k: got[k] for k in r.asDict()} == r.asDict()


def test_snapshot_quantiles_keep_all_snapshots(spark):
    import numpy as np

    from fleetlens.operators import events
    errors = [float((i * 7919) % 1009) for i in range(10_150)]
    df = spark.createDataFrame(list(enumerate(errors)), "event_id long, absolute_error_sec double")
    got = {r.window_index: (r.median_ae_sec, r.p90_error_sec) for r in events.snapshot_quantiles(df, ["event_id"]).collect()}
    assert set(got) == set(range(1, 204)) == {r.window_index for r in events.metric_snapshots(df, ["event_id"]).collect()}
    for w in (1, 2, 3, 100, 203):
        assert got[w] == pytest.approx(tuple(np.quantile(errors[:50 * w], [0.5, 0.9])))
    assert {r.window_index for r in events.snapshot_quantiles(df, ["event_id"], keep=2).collect()} == {202, 203}


def test_changed_new_and_missing_files_are_found(spark, tmp_path):
    from fleetlens.session import materialize
    from fleetlens.sources import readers

    for name in ("same", "edited", "gone"):
        (tmp_path / f"{name}.csv").write_text(f"{name},1\n")
    before = materialize(readers.fingerprints(spark, f"file://{tmp_path}", "*.csv"), "fingerprints")
    assert readers.unchanged(before, readers.fingerprints(spark, f"file://{tmp_path}", "*.csv")).isEmpty()
    (tmp_path / "edited.csv").write_text("edited,2\n")
    (tmp_path / "gone.csv").unlink()
    (tmp_path / "new.csv").write_text("new,1\n")
    changed = readers.unchanged(before, readers.fingerprints(spark, f"file://{tmp_path}", "*.csv")).collect()
    assert {r["path"].rsplit("/", 1)[-1] for r in changed} == {"edited.csv", "gone.csv", "new.csv"}
