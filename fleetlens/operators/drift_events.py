"""Drift events of all detectors in one schema, their summary and status."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.drift_windows import DriftConfig, severity_name, severity_rank
from fleetlens.operators.events import trailing_moments
from fleetlens.operators.sequential import PageHinkley, SplitWindow, detect
from fleetlens.operators.whatif import Scenario
from fleetlens.ordering import OrderBlocks, order_blocks
from fleetlens.session import materialize

RECORD_WIDTH = 6
WINDOW_WIDTH = 4
RESIDUALS = 500
EVIDENCE = "map<string,struct<statistic:double,severity:string>>"


def residual_alarms(df: DataFrame, keys: Sequence[str], order: Sequence[str], error: str,
                    cfg: DriftConfig = DriftConfig(), blocks: OrderBlocks | None = None,
                    alarms_only: bool = True) -> DataFrame:
    """Both sequential detectors over the same errors, in one pass over rows that carry the trailing mean and variance of a key's
    last ``RESIDUALS`` errors; alarm rows, or all rows with their warnings."""
    columns = list(dict.fromkeys([*keys, *order, error]))
    blocks = blocks or order_blocks(df.select(*order), order[0])
    rows = materialize(trailing_moments(df.select(*columns), order, error, RESIDUALS, blocks=blocks, keys=keys), "residuals")
    found = detect(rows, keys, order, error, (PageHinkley.from_config(cfg), SplitWindow.from_config(cfg)), alarms_only, blocks,
                   carry=("mean_residual", "variance_residual"))
    return found.withColumn("threshold", F.when(F.col("detector") == PageHinkley.name, cfg.ph_lambda).otherwise(cfg.adwin_delta))


def concept_events(alarms: DataFrame, keys: Sequence[str], cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Alarm rows (with ``idx``) as drift events; the window is the last 100 records."""
    threshold = F.when(F.col("detector") == "PageHinkley", cfg.ph_lambda).otherwise(cfg.adwin_delta)
    scope = F.concat_ws("_", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("ALL")
    mean = F.col("mean_residual") if "mean_residual" in alarms.columns else F.lit(None).cast("double")
    return alarms.select(
        *keys,
        F.format_string(f"DRIFT_RES_%s_%0{RECORD_WIDTH}d_%s", scope, F.col("idx"), F.col("detector")).alias("event_id"),
        F.lit("CONCEPT_DRIFT").alias("drift_type"), "severity", "detector",
        F.greatest(F.lit(1).cast("long"), F.col("idx") - 100).alias("window_start_idx"),
        F.col("idx").alias("window_end_idx"), F.col("idx").alias("_at"), (F.col("idx") + 1).alias("sample_count"), "statistic",
        threshold.cast("double").alias("threshold"), F.lit(None).cast("double").alias("p_value"),
        F.lit(0.0).alias("baseline_metric"), mean.alias("current_metric"),
        F.array(F.lit("eta_to_next_stop_sec_residual")).alias("affected_features"),
        F.create_map(F.lit("mean_residual"), F.struct(mean.alias("statistic"), F.col("severity"))).cast(EVIDENCE)
        .alias("evidence")).drop("_at")


def data_events(results: DataFrame, bounds: DataFrame, keys: Sequence[str], cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """One event per window with drifting features; at most one list entry per feature."""
    per = [*keys, "window_id"]
    drifted = results.filter(F.col("is_drift") == 1).groupBy(*per).agg(
        F.max(severity_rank(F.col("severity"))).alias("_rank"), F.max("psi").alias("statistic"),
        F.coalesce(F.min("adjusted_p"), F.lit(1.0)).alias("p_value"),
        F.array_sort(F.collect_list("feature")).alias("affected_features"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(
            "feature", F.struct(F.col("psi").alias("statistic"), "severity"))))).cast(EVIDENCE).alias("evidence"))
    scope = F.concat_ws("_", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("ALL")
    return drifted.join(bounds, per).select(
        *keys,
        F.format_string(f"DRIFT_DATA_%s_W%0{WINDOW_WIDTH}d", scope, F.col("window_id") + 1).alias("event_id"),
        F.lit("DATA_DRIFT").alias("drift_type"), severity_name(F.col("_rank")).alias("severity"),
        F.lit("PSI_KS_HYBRID").alias("detector"), "window_start_idx", "window_end_idx",
        (F.col("window_end_idx") - F.col("window_start_idx") + 1).alias("sample_count"), "statistic",
        F.lit(cfg.psi_drift).alias("threshold"), "p_value", F.lit(0.0).alias("baseline_metric"),
        F.col("statistic").alias("current_metric"), "affected_features", "evidence")


def performance_events(windows: DataFrame, keys: Sequence[str], cfg: DriftConfig = DriftConfig(),
                       reference_mae: float | None = None) -> DataFrame:
    scope = F.concat_ws("_", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("ALL")
    measures = ["mae", "rmse", "median_ae", "p90_error", "mae_ratio"]
    evidence = F.create_map(*[x for m in measures for x in (
        F.lit(m), F.struct(F.col(m).alias("statistic"), F.col("severity")))])
    return windows.filter(F.col("is_drift") == 1).select(
        *keys,
        F.format_string(f"DRIFT_PERF_%s_W%0{WINDOW_WIDTH}d", scope, F.col("window_id") + 1).alias("event_id"),
        F.lit("PERFORMANCE_DRIFT").alias("drift_type"), "severity", F.lit("RollingPerformanceMonitor").alias("detector"),
        "window_start_idx", "window_end_idx", "sample_count", F.col("mae_ratio").alias("statistic"),
        F.lit(cfg.perf_drift).alias("threshold"), F.lit(None).cast("double").alias("p_value"),
        F.lit(reference_mae if reference_mae is not None else cfg.reference_mae).alias("baseline_metric"),
        F.col("mae").alias("current_metric"), F.array(F.lit("mae_sec"), F.lit("rmse_sec")).alias("affected_features"),
        evidence.cast(EVIDENCE).alias("evidence"))


def assemble(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def described(events: DataFrame, rows: DataFrame, scenarios: Sequence[Scenario], model_id: str, model_version: str,
              source_type: str = "REPLAY", ts: str = "timestamp_utc", status: str = "OPEN") -> DataFrame:
    """Events with the time of their window's last record, what is known of their scenario, and the source and model behind them.

    The scenarios are a catalog in code, so their table is small; an event of another scenario counts as not synthetic. Only the
    records that end a window meet events, and each event keeps its row.
    """
    spark = events.sparkSession
    known = spark.createDataFrame([(s.scenario_id, s.name, s.synthetic, float(s.intensity)) for s in scenarios],
                                  "scenario_id string, scenario_name string, synthetic_disturbance boolean, disturbance_intensity double")
    times = rows.select("scenario_id", F.col("idx").alias("window_end_idx"), F.col(ts).alias("timestamp_utc"))
    out = events.join(times, ["scenario_id", "window_end_idx"], "left").join(F.broadcast(known), "scenario_id", "left")
    return out.withColumns({
        "scenario_name": F.coalesce("scenario_name", "scenario_id"), "synthetic_disturbance": F.coalesce("synthetic_disturbance", F.lit(False)),
        "disturbance_intensity": F.coalesce("disturbance_intensity", F.lit(0.0)), "source_type": F.lit(source_type),
        "model_id": F.lit(model_id), "model_version": F.lit(model_version), "status": F.lit(status)})


def summary(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per kind, first detection and worst severity, one row per key."""
    kind = F.col("drift_type")
    first = F.min_by(F.struct("window_end_idx", "drift_type", "detector"),
                     F.struct("window_end_idx", "event_id"))
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_alerts"), F.count_if(kind == "DATA_DRIFT").alias("data_drift_alerts"),
        F.count_if(kind == "PERFORMANCE_DRIFT").alias("performance_drift_alerts"),
        F.count_if(kind == "CONCEPT_DRIFT").alias("concept_drift_alerts"), first.alias("_first"),
        severity_name(F.max(severity_rank(F.col("severity")))).alias("max_severity"),
    ).select(*keys, "total_alerts", "data_drift_alerts", "performance_drift_alerts", "concept_drift_alerts",
             F.col("_first.window_end_idx").alias("first_detection_index"),
             F.col("_first.drift_type").alias("first_detection_type"),
             F.col("_first.detector").alias("first_detector_name"), "max_severity")


def frequent_features(events: DataFrame, keys: Sequence[str] = (), n: int = 10) -> DataFrame:
    """The n features named by most data-drift events of each key."""
    counts = events.filter(F.col("drift_type") == "DATA_DRIFT").select(
        *keys, F.explode("affected_features").alias("feature")).groupBy(*keys, "feature").agg(
        F.count(F.lit(1)).alias("alerts"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("alerts"), "feature"))
    return counts.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def status(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Which kinds of drift have been seen and the newest event position."""
    kind = F.col("drift_type")

    def seen(name: str):
        return F.max(F.when(kind == name, 1).otherwise(0)).cast("long")

    return events.groupBy(*keys).agg(
        seen("DATA_DRIFT").alias("data_drift"), seen("PERFORMANCE_DRIFT").alias("performance_drift"),
        seen("CONCEPT_DRIFT").alias("concept_drift"), F.max("window_end_idx").alias("latest_event_idx"),
        F.count(F.lit(1)).alias("events"))
