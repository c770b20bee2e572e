"""Outcomes that come early, late, twice or never, in a stream of files."""

from datetime import datetime, timedelta

from fleetlens.session import scratch_path
from fleetlens.sources.readers import replay_stream
from fleetlens.streaming import jobs

START = datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else START + timedelta(minutes=minutes)


def add_file(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def settle(spark, files):
    """Each step adds a file of predictions and one of outcomes, then starts the query anew on the same checkpoint."""
    p, o, folder, checkpoint = (scratch_path(spark, x) for x in ("made", "seen", "settled", "settled-checkpoint"))
    ps, os = "prediction_id long, predicted double, predicted_at timestamp", "prediction_id long, actual double, observed_at timestamp"
    for made, seen in files:
        add_file(spark, p, [(i, float(v), at(t)) for i, v, t in made], ps)
        add_file(spark, o, [(i, float(v), at(t)) for i, v, t in seen], os)
        schemas = [spark.createDataFrame([], x).schema for x in (ps, os)]
        jobs.settle_outcomes(replay_stream(spark, p, schemas[0]), replay_stream(spark, o, schemas[1]), folder, checkpoint,
                             delay="60 MINUTES", late="30 MINUTES").awaitTermination()
    rows = jobs.settled_outcomes(spark, folder).collect()
    return sorted(((r["id"], r["prediction"] and r["prediction"]["predicted"], r["outcome"] and r["outcome"]["actual"], r["status"]) for r in rows), key=str)


def test_each_row_leaves_once(spark):
    got = settle(spark, [
        ([(1, 10, 0), (2, 20, 1), (3, 30, 2), (None, 40, 3), (9, 90, None)], [(4, 41, 5), (1, 11, 4), (1, 12, 6)]),  # 4: outcome before its prediction arrives
        ([(4, 40, 4), (5, 50, 100), (5, 50, 100)], [(3, 33, 80), (5, 51, 110)]),  # 3: seen 78 minutes later; 5: equal predictions
        ([(6, 60, 300)], [(2, 21, 30), (7, 70, 299)]),  # 2: in time, but arrives after the prediction was given up
    ])
    assert got == sorted([
        (1, 10.0, 11.0, "RESOLVED"), (1, None, 12.0, "ORPHAN"), (2, 20.0, None, "UNRESOLVED"), (2, None, 21.0, "ORPHAN"), (3, 30.0, None, "UNRESOLVED"),
        (3, None, 33.0, "ORPHAN"), (4, 40.0, 41.0, "RESOLVED"), (5, 50.0, 51.0, "RESOLVED"), (5, 50.0, 51.0, "RESOLVED"), (6, 60.0, None, "OPEN"),
        (7, None, 70.0, "OPEN"), (9, 90.0, None, "UNRESOLVED"), (None, 40.0, None, "UNRESOLVED")], key=str)


def test_order_of_files_does_not_matter_within_lateness(spark):
    files = [([(i, i, 3 * i) for i in range(k, 9, 3)], [(i, i + 1, 3 * i + 2) for i in range(2 - k, 9, 3) if i != 4]) for k in range(3)]
    got = settle(spark, files)
    assert got == settle(spark, files[::-1])
    assert got == sorted([(i, float(i), float(i + 1), "RESOLVED") if i != 4 else (4, 4.0, None, "OPEN") for i in range(9)], key=str)
