"""Drift statistics against NumPy, detectors against plain loops, decisions and lifecycle rules."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetlens.functions.stats import hash_route
from fleetlens.operators import decisions, drift_stats, drift_windows, lifecycle, sequential
from fleetlens.operators.drift_windows import DriftConfig
from fleetlens.ordering import order_blocks
from fleetlens.sources.readers import replay_stream, write_replay_files
from fleetlens.session import scratch_path
from fleetlens.streaming.jobs import collect_stream


def long(spark, values, feature="x"):
    return spark.createDataFrame(pd.DataFrame({"feature": feature, "value": np.asarray(values, dtype=float)}))


def distances(spark, ref, cur):
    r, c = long(spark, ref), long(spark, cur)
    profile = drift_stats.numeric_profile(r)
    return drift_stats.binned_distances(drift_stats.binned_counts(r, profile), drift_stats.binned_counts(c, profile), profile).first()


def test_psi_and_js(spark):
    rng = np.random.default_rng(42)
    base, moved = rng.normal(100, 15, 5000), rng.normal(140, 25, 5000)
    same, far = distances(spark, base, base), distances(spark, base, moved)
    assert same.psi < 0.01 and far.psi > 0.25 and 0 <= far.js_distance <= 1
    edges = np.unique(np.percentile(base, np.linspace(0, 100, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    p, q = [(np.histogram(v, edges)[0] + 1.0) / (len(v) + 10) for v in (base, moved)]
    assert far.psi == pytest.approx(float(((q - p) * np.log(q / p)).sum()), rel=1e-9)
    assert 0.5 < distances(spark, rng.normal(0, 1, 2000), rng.normal(5, 1, 2000)).js_distance <= 1


def test_point_mass_edges(spark):
    values = [0.0] * 40 + list(range(1, 61))
    edges = drift_stats.numeric_profile(long(spark, values)).first().bin_edges
    rest = np.percentile(np.arange(1, 61), np.linspace(0, 100, 10))
    np.testing.assert_allclose(edges, np.unique(np.concatenate([[-1e-4, 1e-4], rest])))
    assert drift_stats.numeric_profile(long(spark, [5.0] * 9)).first().bin_edges == [4.0, 6.0]


def ks_direct(a, b):
    grid = np.union1d(a, b)
    f = lambda v: np.searchsorted(np.sort(v), grid, "right") / len(v)
    return np.abs(f(a) - f(b)), grid


def test_ks_and_wasserstein(spark):
    rng = np.random.default_rng(7)
    a, b = np.round(rng.normal(100, 15, 1000), 1), np.round(rng.normal(120, 15, 700), 1)
    for blocks in (None, order_blocks(long(spark, a), "value", rows_per_block=100)):
        got = drift_stats.ks_two_sample(long(spark, a), long(spark, b), blocks=blocks).first()
        gap, grid = ks_direct(a, b)
        assert got.ks_statistic == pytest.approx(gap.max())
        assert got.wasserstein == pytest.approx((gap[:-1] * np.diff(grid)).sum())
        assert got.p_value < 1e-10
    assert drift_stats.ks_two_sample(long(spark, a), long(spark, a)).first().p_value == 1.0


def test_windowed_ks_equals_two_sample(spark):
    rng = np.random.default_rng(3)
    ref = np.round(rng.gamma(2, 20, 3000), 0)
    windows = {w: np.round(rng.gamma(2, 20 + 5 * w, 200), 0) for w in range(4)}
    cur = spark.createDataFrame(pd.concat([pd.DataFrame({"window_id": w, "feature": "x", "value": v}) for w, v in windows.items()]))
    for blocks in (None, order_blocks(long(spark, ref), "value", rows_per_block=150)):
        got = {r.window_id: r.ks_statistic for r in drift_stats.windowed_ks(long(spark, ref), cur, blocks=blocks).collect()}
        for w, v in windows.items():
            assert got[w] == pytest.approx(ks_direct(ref, v)[0].max(), abs=1e-12)


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.8]
    df = spark.createDataFrame([(0, f"f{i}", v) for i, v in enumerate(p)], "w int, feature string, p_value double")
    got = {r.feature: (r.adjusted_p, r.rejected) for r in drift_stats.benjamini_hochberg(df, ["w"]).collect()}
    order = np.argsort(p)
    adjusted = np.minimum.accumulate([p[i] * 5 / (r + 1) for r, i in reversed(list(enumerate(order)))])[::-1]
    for r, i in enumerate(order):
        assert got[f"f{i}"][0] == pytest.approx(adjusted[r])
        assert got[f"f{i}"][1] == int(adjusted[r] <= 0.05)


def categorical(ref, cur):
    names = sorted(set(ref) | set(cur))
    p = np.array([max(ref.get(c, 0) / sum(ref.values()), 1e-4) for c in names])
    q = np.array([max(cur.get(c, 0) / sum(cur.values()), 1e-4) for c in names])
    p, q = p / p.sum(), q / q.sum()
    return ((q - p) * np.log(q / p)).sum()


@pytest.mark.parametrize("cur", [{"A": 250, "B": 150, "C": 100}, {"A": 50, "B": 100, "C": 850}, {"A": 5, "Z": 3}, {"Y": 1}])
def test_categorical_psi(spark, cur):
    ref = {"A": 500, "B": 300, "C": 200}
    frame = lambda d: spark.createDataFrame([("c", k, v) for k, v in d.items()], "feature string, category string, records long")
    got = drift_stats.categorical_psi(frame(ref), frame(cur)).first()
    assert got.psi == pytest.approx(max(categorical(ref, cur), 0.0), abs=1e-12)
    assert got.categories == len(set(ref) | set(cur))


@pytest.mark.parametrize("n", [50, 99, 100, 499, 500, 749, 1000, 1010, 1200, 1349])
def test_count_windows(spark, n):
    got = drift_windows.window_bounds(drift_windows.sliding_windows(
        spark.range(n).select(F.col("id").alias("idx"), F.lit(n).cast("long").alias("n")))).orderBy("window_id").collect()
    want, start = [], 0
    while start + 500 <= n:
        want.append((start, start + 499))
        start += 250
    if n - start >= 100:
        want.append((start, n - 1))
    assert [(r.window_start_idx, r.window_end_idx) for r in got] == want


def test_tail_performance_window_takes_the_last_records(spark):
    rows = spark.range(1100).select(F.col("id").alias("idx"), F.lit(1100).cast("long").alias("n"), F.lit(10.0).alias("signed_error_sec"),
                                    F.lit(10.0).alias("absolute_error_sec"))
    last = drift_windows.performance_windows(rows).orderBy(F.desc("window_id")).first()
    assert (last.window_start_idx, last.window_end_idx, last.sample_count, last.severity) == (600, 1099, 500, "NONE")


def test_performance_severity(spark):
    rng = np.random.default_rng(1)
    e = np.concatenate([rng.normal(0, 20, 100), np.full(100, 150.0)])
    rows = spark.createDataFrame(pd.DataFrame({"idx": range(200), "n": 200, "signed_error_sec": e, "absolute_error_sec": np.abs(e)}))
    cfg = DriftConfig(window_size=100, step_size=100, reference_mae=40, reference_rmse=60)
    got = [r.severity for r in drift_windows.performance_windows(rows, cfg=cfg).orderBy("window_id").collect()]
    assert got[0] == "NONE" and got[1] in ("HIGH", "CRITICAL")


def loop_page_hinkley(errors, det):
    u = low = 0.0
    alarms = []
    for i, e in enumerate(errors):
        u = det.alpha * u + (abs(e) - det.mean) / max(det.std, 5.0) - det.delta
        low = min(low, u)
        if u - low >= det.threshold:
            alarms.append(i)
            u = low = 0.0
    return alarms


def loop_split(errors, det):
    window, wait, alarms = [], 0, []
    for i, e in enumerate(errors):
        window = (window + [abs(e)])[-det.max_window:]
        if wait:
            wait -= 1
            continue
        if len(window) < det.min_window:
            continue
        m = len(window) // 2
        a, b = np.array(window[:m]), np.array(window[m:])
        cut = math.sqrt(2 * (1 / len(a) + 1 / len(b)) * math.log(2 / det.delta)) * (np.std(window) + 1)
        gap = b.mean() - a.mean()
        if gap > cut and gap >= det.min_gain:
            alarms.append(i)
            window, wait = window[m:], det.cooldown
    return alarms


@pytest.fixture(scope="module")
def error_stream(spark):
    rng = np.random.default_rng(11)
    parts = []
    for key, n in (("hot", 3000), ("a", 700), ("b", 40)):
        level = np.where(np.arange(n) % 1500 > 900, 120.0, 30.0)
        parts.append(pd.DataFrame({"key": key, "idx": range(n), "e": rng.normal(0, 1, n) * level}))
    return pd.concat(parts, ignore_index=True)


DETECTORS = [(sequential.PageHinkley(25.0, 20.0, threshold=20.0), loop_page_hinkley),
             (sequential.SplitWindow(min_gain=10.0), loop_split)]


@pytest.mark.parametrize("detector,loop", DETECTORS, ids=["page-hinkley", "split-window"])
def test_detectors_equal_loops_in_one_and_many_blocks(spark, error_stream, detector, loop):
    df = spark.createDataFrame(error_stream)
    want = sorted((k, int(i)) for k, g in error_stream.groupby("key") for i in loop(g.e.to_numpy(), detector))
    assert len(want) >= 2
    for rows in (10**9, 400):
        blocks = order_blocks(df, "idx", rows_per_block=rows)
        got = sequential.detect(df, ["key"], ["idx"], "e", detector, blocks=blocks).collect()
        assert sorted((r.key, r.idx) for r in got) == want


@pytest.mark.parametrize("detector,loop", DETECTORS, ids=["page-hinkley", "split-window"])
def test_streamed_detector_equals_batch(spark, error_stream, detector, loop):
    df = spark.createDataFrame(error_stream)
    path = scratch_path(spark, "errors")
    write_replay_files(df, path, ("idx", "key"), 900)
    stream = sequential.stream_detect(replay_stream(spark, path, df.schema), ["key"], ["idx"], "e", detector, alarms_only=False)
    key = ["key", "idx"]
    got = collect_stream(stream, "alarms").toPandas().sort_values(key, ignore_index=True)
    want = sequential.detect(df, ["key"], ["idx"], "e", detector, alarms_only=False).toPandas().sort_values(key, ignore_index=True)
    assert (got.in_drift == want.in_drift).all() and (got.severity == want.severity).all()
    np.testing.assert_allclose(got.statistic, want.statistic, atol=1e-9)


def rows_of_loop(detector, errors):
    """Statistic of every row by plain loops."""
    found, u, low = [], 0.0, 0.0
    if isinstance(detector, sequential.PageHinkley):
        for e in errors:
            u = detector.alpha * u + (abs(e) - detector.mean) / max(detector.std, 5.0) - detector.delta
            low = min(low, u)
            found.append(u - low)
            if u - low >= detector.threshold:
                u = low = 0.0
        return found
    window, wait = [], 0
    for e in errors:
        window = (window + [abs(e)])[-detector.max_window:]
        found.append(0.0)
        if wait:
            wait -= 1
        elif len(window) >= detector.min_window:
            m = len(window) // 2
            a, b = np.array(window[:m]), np.array(window[m:])
            cut = math.sqrt(2 * (1 / len(a) + 1 / len(b)) * math.log(2 / detector.delta)) * (np.std(window) + 1)
            found[-1] = abs(b.mean() - a.mean())
            if b.mean() - a.mean() > cut and found[-1] >= detector.min_gain:
                window, wait = window[m:], detector.cooldown
    return found


@pytest.mark.parametrize("detector", [d for d, _ in DETECTORS] + [sequential.PageHinkley(25.0, 20.0, threshold=2.0), sequential.PageHinkley(25.0, 20.0, alpha=1.0)])
@pytest.mark.parametrize("scale", [1.0, 30.0, 90.0])
def test_statistics_of_rows_equal_plain_loops(detector, scale):
    errors = np.random.default_rng(3).normal(0, scale, 7000) * np.where(np.arange(7000) % 2300 > 1700, 3.0, 1.0)
    state, found = detector.start, []
    for part in np.array_split(errors, [1, 1, 90, 4000]):
        state, statistics, _ = detector.fold(state, part)
        found.append(statistics)
    np.testing.assert_allclose(np.concatenate(found), rows_of_loop(detector, errors), atol=1e-8)


def rounds_of(detector, errors, parts):
    """Entries of blocks as the distributed loop finds them, and its rounds."""
    blocks = np.array_split(errors, parts)
    entries, known, rounds = [detector.start] * parts, [None] * parts, 0
    while True:
        rounds += 1
        for k, b in enumerate(blocks):
            if known[k] is None or known[k][0] != entries[k]:
                known[k] = (entries[k], *detector.summary(entries[k], b))
        after = detector.entries(known)
        if after == entries:
            return entries, rounds
        entries = after


@pytest.mark.parametrize("detector", [sequential.PageHinkley(25.0, 20.0, threshold=1e9), sequential.PageHinkley(25.0, 20.0, threshold=20.0), sequential.SplitWindow(min_gain=10.0)])
def test_blocks_compose(detector):
    errors = np.random.default_rng(4).normal(0, 30, 120_000)
    entries, rounds = rounds_of(detector, errors, 100)
    state = detector.start
    for entry, block in zip(entries, np.array_split(errors, 100), strict=True):
        np.testing.assert_allclose(entry, state, atol=1e-7)
        state = detector.fold(state, block)[0]
    if getattr(detector, "threshold", 0) == 1e9 or isinstance(detector, sequential.SplitWindow):
        assert rounds <= 3


def test_page_hinkley_quiet_then_alarm():
    det = sequential.PageHinkley(5.0, 3.0, 0.2, 20.0)
    state, stat, sev = det.fold(det.start, np.random.default_rng(0).normal(0, 5, 100))
    assert not set(sev) & set(det.alarm_levels)
    assert set(det.fold(state, np.full(30, 60.0))[2]) & set(det.alarm_levels)


def test_hash_route(spark):
    ids = [f"trip-{i}" for i in range(500)]
    df = spark.createDataFrame([(i,) for i in ids], "t string")
    got = [r.ok for r in df.select("t", hash_route(F.col("t"), 37).alias("ok")).collect()]
    assert got == [int(hashlib.md5(i.encode()).hexdigest(), 16) % 100 < 37 for i in ids]
    assert not df.filter(hash_route(F.col("t"), 0)).count() and df.filter(hash_route(F.col("t"), 100)).count() == 500


def decide(spark, **given):
    row = {"stream_index": 15000, "last_retrain_index": None, "buffer_size": 5000, "sustained": 0, "recent_alarms": 0, "same_alarms": 0, "data_drift_events": 0, **given}
    schema = "stream_index long, last_retrain_index long, buffer_size long, sustained long, recent_alarms long, same_alarms long, data_drift_events long"
    got = decisions.trigger_decisions(spark.createDataFrame([tuple(row.values())], schema)).first()
    return got.should_retrain, got.severity


def test_trigger_rules(spark):
    assert decide(spark) == (0, "NORMAL")
    assert decide(spark, sustained=1) == (1, "CRITICAL")
    assert decide(spark, recent_alarms=3) == (1, "CRITICAL")
    assert decide(spark, recent_alarms=3, same_alarms=1) == (0, "INFO")
    assert decide(spark, data_drift_events=4) == (0, "WARNING")
    assert decide(spark, sustained=1, stream_index=1800, last_retrain_index=1000) == (0, "INFO")
    assert decide(spark, sustained=1, buffer_size=500) == (0, "INFO")


def test_sustained_windows(spark):
    history = spark.createDataFrame([(0, 500, 40.0), (1, 500, 68.0), (2, 500, 71.5), (3, 500, 30.0), (4, 500, 99.0)], "window_index long, samples long, mae_sec double")
    got = [tuple(r) for r in decisions.degraded_runs(history).select("first_window", "last_window", "trigger_window").collect()]
    assert got == [(1, 2, 2)]


@pytest.mark.parametrize("positions,count", [((2000, 6000, 12000), 0), ((13000, 14000, 14800), 3)])
def test_alarm_recency(spark, positions, count):
    alarms = spark.createDataFrame([(f"E{p}", p) for p in positions], "event_id string, idx long")
    got = {r.stream_index: r.recent_alarms for r in decisions.recent_alarms(alarms).collect()}
    assert got.get(15000, 0) == count


def gate(spark, candidate_mae=43.0, recent=41.0, **extra):
    rows = [("champion", "original", 44.0, 72.0, 147.0, 0.70, 0.0, 0), ("champion", "recent", 42.0, 70.0, 140.0, 0.70, 0.0, 0),
            ("candidate", "original", candidate_mae, 71.0, 146.0, extra.get("r2", 0.71), extra.get("non_positive", 0.0), extra.get("excessive", 0)),
            ("candidate", "recent", recent, 69.0, 139.0, 0.71, 0.0, 0)]
    return decisions.promotion_gate(spark.createDataFrame(
        rows, "model string, holdout string, mae_sec double, rmse_sec double, p95_error_sec double, r2 double, non_positive_pct double, excessive_count long")).first()


def test_promotion_gate(spark):
    assert gate(spark).passed == 1
    worse = gate(spark, candidate_mae=98.0)
    assert (worse.gate_a, worse.gate_b, worse.gate_c, worse.passed) == (0, 1, 1, 0) and "MAE on original" in worse.failure_reasons
    assert gate(spark, recent=43.0).gate_b == 0 and gate(spark, r2=0.6).gate_a == 0
    assert gate(spark, excessive=1).gate_c == 0 and gate(spark, non_positive=0.5).gate_c == 0


def pairs(spark, n, champion, candidate):
    return spark.range(n).select(F.col("id").alias("idx"), F.concat(F.lit("t"), F.col("id") % 20).alias("trip_id"), F.timestamp_seconds("id").alias("timestamp_utc"),
                                 F.lit(100.0).alias("y"), F.lit(champion).alias("a"), F.lit(candidate).alias("b"))


def test_shadow_canary_and_watchdog(spark):
    assert decisions.shadow_check(pairs(spark, 400, 110.0, 109.0), "y", "a", "b").first().passed == 1
    assert "non-positive" in decisions.shadow_check(pairs(spark, 400, 110.0, -1.0), "y", "a", "b").first().failure_reasons
    assert decisions.canary_stage(pairs(spark, 300, 110.0, 110.0), 100, "y", "a", "b").first().passed == 1
    assert "too few" in decisions.canary_stage(pairs(spark, 10, 110.0, 110.0), 100, "y", "a", "b").first().failure_reasons
    assert decisions.canary_stage(pairs(spark, 300, 110.0, 120.0), 100, "y", "a", "b").first().passed == 0
    seen = pairs(spark, 900, 0.0, 0.0).withColumn("absolute_error_sec", F.when(F.col("idx") < 500, 77.0).otherwise(0.0))
    assert decisions.watchdog(seen).first().rollback_triggered == 1
    assert decisions.watchdog(seen, baseline_mae=80.0).first().rollback_triggered == 0


def test_a_bad_stretch_is_not_averaged_away(spark):
    """The only bad window is found wherever it stands, the incomplete last one too; latency and exceptions trip by themselves."""
    for bad in (0, 3, 8):
        rows = pairs(spark, 4200, 110.0, 105.0).withColumns({"absolute_error_sec": F.when(F.floor(F.col("idx") / 500) == bad, 77.0).otherwise(1.0),
                                                             "latency_ms": F.lit(1.0), "failed": F.lit(False)})
        got = decisions.watchdog(rows, latency="latency_ms", exception="failed").first()
        assert (got.rollback_triggered, got.window_index, got.rollback_reason, got.windows, got.tripped_windows) == (1, bad, "MAE", 9, 1)
        worse = rows.withColumn("b", F.when(F.floor(F.col("idx") / 500) == bad, 140.0).otherwise(F.col("b")))
        for verdicts in (decisions.shadow_check(worse, "y", "a", "b", window=500), decisions.canary_stage(worse, 100, "y", "a", "b", window=500)):
            assert {r.window_index for r in verdicts.filter("passed = 0").collect()} == {bad} and verdicts.count() == 9
        assert decisions.shadow_check(worse, "y", "a", "b").first().passed == 1
    calm = rows.withColumn("absolute_error_sec", F.lit(1.0))
    slow = calm.withColumn("latency_ms", F.when(F.col("idx").between(1000, 1499), 30.0).otherwise(1.0))
    assert [decisions.watchdog(x, latency="latency_ms", exception="failed").first().rollback_reason for x in (calm, slow, calm.withColumn("failed", F.col("idx") == 4100))] == ["", "latency", "exceptions"]
    empty = decisions.watchdog(calm.limit(0)).first()
    assert (empty.samples, empty.rollback_triggered, empty.windows) == (0, 0, 0)


CHAIN = ["CANDIDATE", "VALIDATED", "SHADOW", "CANARY_10", "CANARY_50", "PROMOTION_CANDIDATE", "PRODUCTION"]


def test_lifecycle_rules(spark):
    log = spark.createDataFrame([("m", i, s) for i, s in enumerate(CHAIN)], "model_id string, ts long, to_status string")
    assert lifecycle.check_transitions(log, ["ts"]).filter("is_legal = 0").count() == 0
    jumps = [("CANDIDATE", "PRODUCTION"), ("CANDIDATE", "SHADOW"), ("SHADOW", "PRODUCTION"), ("CANARY_10", "PRODUCTION"), ("REJECTED", "CANDIDATE"),
             ("ROLLED_BACK", "PRODUCTION"), ("ARCHIVED", "SHADOW"), ("PRODUCTION", "CANDIDATE"), ("VALIDATED", "CANARY_10")]
    rows = spark.createDataFrame(jumps, "a string, b string")
    assert rows.filter(lifecycle.is_allowed(F.col("a"), F.col("b"))).count() == 0
    status = lifecycle.current_status(log, ["ts"])
    assert status.first().status == "PRODUCTION"
    models = spark.createDataFrame([("m", None)], "model_id string, parent_model_id string")
    assert lifecycle.rollback_targets(status, models, "first_champion").first().rollback_to == "first_champion"


def test_exact_p_values_equal_enumeration_and_closed_form(spark):
    from itertools import combinations

    from fleetlens.functions.stats import path_share

    for n1, n2 in ((1, 1), (3, 4), (5, 5), (2, 9)):
        gaps = []
        for chosen in combinations(range(n1 + n2), n1):
            i = np.cumsum([k in chosen for k in range(n1 + n2)])
            gaps.append(round(np.abs(i * n2 - (np.arange(1, n1 + n2 + 1) - i) * n1).max()))
        for g in range(n1 * n2 + 1):
            assert path_share(g / (n1 * n2), n1, n2) == pytest.approx(np.mean(np.array(gaps) >= g))
    for n, h in ((500, 3), (500, 40), (500, 130), (200, 200)):
        lg = math.lgamma
        want = 2 * sum((-1) ** (k + 1) * math.exp(2 * lg(n + 1) - lg(n + 1 - k * h) - lg(n + 1 + k * h)) for k in range(1, n // h + 1))
        assert path_share(h / n, n, n) == pytest.approx(min(want, 1.0), rel=1e-9)
    tests = spark.createDataFrame([(0.5, 4, 6, 0.9), (0.5, 20_000, 6, 0.25), (0.1, 0, 5, 0.7)], "ks_statistic double, reference_count long, current_count long, p_value double")
    got = [r.p_value for r in drift_stats.with_exact_p(tests).orderBy("reference_count").collect()]
    assert got[0] == 0.7 and got[1] == pytest.approx(path_share(0.5, 4, 6)) and got[2] == 0.25


def test_categories_of_windows(spark):
    """Category columns against the plain formula; records without a category, a new one, and a window that has none."""
    from math import log

    from fleetlens.operators import drift_detect, drift_stats
    from fleetlens.operators.drift_windows import DriftConfig
    cfg = DriftConfig(window_size=4, step_size=2, min_window_size=2)
    line = ["a", "b", "a", None, "c", "c", "c", "c", None, None, None, None]
    rows = spark.createDataFrame([(i, len(line), v) for i, v in enumerate(line)], "idx long, n long, segment string")
    reference = drift_stats.categorical_profile(spark.createDataFrame([(x,) for x in "aaabbd"], "segment string"), ["segment"])
    stats = drift_detect.classify_categorical(drift_detect.window_category_stats(rows, ["segment"], reference, cfg=cfg), cfg)
    got = {r["window_id"]: r for r in stats.collect()}

    def plain(values):
        ref = {"a": 3, "b": 2, "d": 1}
        names = sorted({*ref, *values})
        p = [max(ref.get(x, 0) / 6, 1e-4) for x in names]
        q = [max(values.count(x) / len(values), 1e-4) for x in names]
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        return sum((b - a) * log(b / a) for a, b in zip(p, q, strict=True))

    starts = range(0, 11, 2)
    assert sorted(got) == list(range(len(starts)))
    for w, start in enumerate(starts):
        values = [v for v in line[start:start + 4] if v]
        assert got[w]["sample_count"] == len(line[start:start + 4]) and got[w]["ref_sample_count"] == 6 and got[w]["is_drift"] == 0
        if values:
            assert abs(got[w]["psi"] - plain(values)) < 1e-9 and got[w]["severity"] == ("LOW" if plain(values) >= 0.6 else "NONE")
        else:
            assert got[w]["psi"] is None and got[w]["severity"] == "NONE"


def test_equal_exact_p_values_are_counted_once_and_dealt_over_tasks(spark):
    from fleetlens.functions import stats
    stats._share_beyond.cache_clear()
    assert len({stats.path_share(0.25, 40, 60) for _ in range(5)}) == 1 and stats._share_beyond.cache_info().hits == 4
    tests = spark.range(200).select((F.col("id") % 20 / 20).alias("ks_statistic"), F.lit(20).cast("long").alias("reference_count"),
                                    F.lit(20).cast("long").alias("current_count"), F.lit(0.5).alias("p_value"), "id").coalesce(1)
    found = drift_stats.with_exact_p(tests)
    by_task = found.select("ks_statistic", "p_value", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(by_task) == 20 and len({r.task for r in by_task}) > 1
    assert all(r.p_value == pytest.approx(stats.path_share(r.ks_statistic, 20, 20)) for r in by_task)
