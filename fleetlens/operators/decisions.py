"""Retrain triggers, promotion gates, shadow, canary and watchdog decisions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.stats import hash_route
from fleetlens.operators.evaluation import regression_metrics
from fleetlens.ordering import Ordered, OrderBlocks
from fleetlens.quantiles import summarize


@dataclass(frozen=True)
class TriggerPolicy:
    """Fixed values of the retraining policy unless overridden."""

    sustained_windows: int = 2
    min_window_samples: int = 500
    degradation_ratio: float = 1.60
    alarm_threshold: int = 3
    alarm_window: int = 2500
    cooldown: int = 1500
    min_new_records: int = 1000
    baseline_mae: float = 38.77


@dataclass(frozen=True)
class GateLimits:
    """Fixed values of the promotion gates unless overridden."""

    original_mae_ratio: float = 1.01
    original_r2_drop: float = 0.01
    recent_mae_ratio: float = 1.00
    rmse_ratio: float = 1.05
    p95_ratio: float = 1.08
    non_positive_pct: float = 0.0
    excessive_count: int = 0
    latency_ms: float = 5.0


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the broken rules, joined; empty when all hold."""
    return F.concat_ws("; ", F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])))


def metric_history(df: DataFrame, size: int = 500, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics of consecutive, complete blocks of ``size`` indexed records."""
    e = F.col("absolute_error_sec")
    return df.groupBy(*keys, F.floor(F.col("idx") / size).alias("window_index")).agg(
        F.count(F.lit(1)).alias("samples"), F.avg(e).alias("mae_sec"), F.sqrt(F.avg(e * e)).alias("rmse_sec")
    ).filter(F.col("samples") == size)


def degraded_runs(history: DataFrame, policy: TriggerPolicy = TriggerPolicy(), keys: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive degraded windows that are long enough to act on.

    Consecutive windows share (window number - position among degraded windows).
    """
    bad = history.filter((F.col("samples") >= policy.min_window_samples)
                         & (F.col("mae_sec") / policy.baseline_mae >= policy.degradation_ratio))
    placed = Ordered(bad, list(keys), ["window_index"]).row_number("_rn").frame()
    runs = placed.groupBy(*keys, (F.col("window_index") - F.col("_rn")).alias("_island")).agg(
        F.min("window_index").alias("first_window"), F.max("window_index").alias("last_window"),
        F.count(F.lit(1)).alias("consecutive_windows"))
    return runs.filter(F.col("consecutive_windows") >= policy.sustained_windows).drop("_island").withColumn(
        "trigger_window", F.col("first_window") + policy.sustained_windows - 1)


def recent_alarms(alarms: DataFrame, policy: TriggerPolicy = TriggerPolicy(), every: int = 500,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Alarms within the trailing window of each evaluation point (multiples of ``every``).

    An alarm is visible from its position for ``alarm_window`` records, so it is
    repeated for the few points it reaches instead of joined by range.
    """
    first = F.ceil(F.col("idx") / every)
    last = F.floor((F.col("idx") + policy.alarm_window) / every)
    points = F.transform(F.sequence(first, last), lambda step: step * every)
    reach = alarms.withColumn("stream_index", F.explode(points))
    id_digest = F.conv(F.substring(F.md5(F.col("event_id").cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return reach.groupBy(*keys, "stream_index").agg(
        F.count(F.lit(1)).alias("recent_alarms"), F.sum(id_digest).cast("string").alias("alarm_set"))


def repeated_alarms(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Marks points whose alarm set equals the one of the point before."""
    seq = Ordered(points, list(keys), ["stream_index"]).lag("alarm_set", 1, "_before").frame()
    same = F.coalesce(F.col("_before") == F.col("alarm_set"), F.lit(False))
    return seq.withColumn("same_alarms", F.when(same, 1).otherwise(0).cast("long")).drop("_before")


def trigger_decisions(points: DataFrame, policy: TriggerPolicy = TriggerPolicy()) -> DataFrame:
    """Decision, severity and reason per evaluation point, by rule priority.

    Columns used: stream_index, last_retrain_index (nullable), buffer_size,
    sustained (0/1), recent_alarms, same_alarms (0/1), data_drift_events.
    """
    c = F.col
    cooling = c("last_retrain_index").isNotNull() & (c("stream_index") - c("last_retrain_index") < policy.cooldown)
    rules = [
        (cooling, 0, "INFO", "cooldown active"),
        (c("buffer_size") < policy.min_new_records, 0, "INFO", "insufficient data"),
        (c("sustained") == 1, 1, "CRITICAL", "sustained performance drift"),
        ((c("recent_alarms") >= policy.alarm_threshold) & (c("same_alarms") == 1), 0, "INFO", "alarms already evaluated"),
        (c("recent_alarms") >= policy.alarm_threshold, 1, "CRITICAL", "emergency concept drift"),
        (c("data_drift_events") > 0, 0, "WARNING", "data drift is advisory"),
    ]
    outcome = F.struct(F.lit(0).cast("long").alias("should_retrain"), F.lit("NORMAL").alias("severity"),
                       F.lit("nominal").alias("reason"))
    for condition, act, severity, reason in reversed(rules):
        outcome = F.when(condition, F.struct(F.lit(act).cast("long").alias("should_retrain"),
                                             F.lit(severity).alias("severity"), F.lit(reason).alias("reason"))
                         ).otherwise(outcome)
    return points.withColumn("_d", outcome).select(*points.columns, "_d.*")


def ratio(candidate: Column, champion: Column) -> Column:
    return F.when(champion > 0, candidate / champion).otherwise(1.0)


def promotion_gate(metrics: DataFrame, limits: GateLimits = GateLimits()) -> DataFrame:
    """Three gates from metrics per (model, holdout).

    ``model`` is champion/candidate, ``holdout`` original/recent; ``latency_ms`` is
    the mean scoring time per row and may be NULL.
    """
    names = ["mae_sec", "rmse_sec", "p95_error_sec", "r2", "non_positive_pct", "excessive_count", "latency_ms"]
    if "latency_ms" not in metrics.columns:
        metrics = metrics.withColumn("latency_ms", F.lit(None).cast("double"))

    def pick(model: str, holdout: str, name: str) -> Column:
        here = (F.col("model") == model) & (F.col("holdout") == holdout)
        return F.max(F.when(here, F.col(name))).alias(f"{model}_{holdout}_{name}")

    wide = metrics.agg(*[pick(m, h, n) for m in ("champion", "candidate") for h in ("original", "recent") for n in names])

    def of(model: str, holdout: str, name: str) -> Column:
        return F.col(f"{model}_{holdout}_{name}")

    def compare(holdout: str, name: str) -> Column:
        return ratio(of("candidate", holdout, name), of("champion", holdout, name))

    row = wide.select(
        "*", compare("original", "mae_sec").alias("original_mae_ratio"),
        (of("champion", "original", "r2") - of("candidate", "original", "r2")).alias("original_r2_drop"),
        compare("recent", "mae_sec").alias("recent_mae_ratio"), compare("original", "rmse_sec").alias("original_rmse_ratio"),
        compare("original", "p95_error_sec").alias("original_p95_ratio"))
    a = {"A: MAE on original holdout": F.col("original_mae_ratio") > limits.original_mae_ratio,
         "A: R2 on original holdout": F.col("original_r2_drop") > limits.original_r2_drop}
    b = {"B: MAE on recent holdout": F.col("recent_mae_ratio") > limits.recent_mae_ratio}
    c = {"C: RMSE": F.col("original_rmse_ratio") > limits.rmse_ratio,
         "C: P95": F.col("original_p95_ratio") > limits.p95_ratio,
         "C: non-positive predictions": of("candidate", "original", "non_positive_pct") > limits.non_positive_pct,
         "C: excessive predictions": of("candidate", "original", "excessive_count") > limits.excessive_count,
         "C: latency": F.coalesce(of("candidate", "original", "latency_ms") > limits.latency_ms, F.lit(False))}

    def passed(rules: dict[str, Column]) -> Column:
        return F.when(reasons(rules) == "", 1).otherwise(0).cast("long")

    return row.select("original_mae_ratio", "original_r2_drop", "recent_mae_ratio", "original_rmse_ratio",
                      "original_p95_ratio", passed(a).alias("gate_a"), passed(b).alias("gate_b"), passed(c).alias("gate_c"),
                      passed({**a, **b, **c}).alias("passed"), reasons({**a, **b, **c}).alias("failure_reasons"))


def holdout_metrics(parts: dict[str, DataFrame], models: dict[str, str], actual: str,
                    blocks: dict[str, OrderBlocks] | None = None) -> DataFrame:
    """Gate metrics per (model, holdout) from tables holding both models' predictions."""
    out = None
    for holdout, df in parts.items():
        stacked = df.select(F.col(actual).alias("_y"), *[F.col(p).alias(m) for m, p in models.items()]).unpivot(
            ["_y"], list(models), "model", "_p")
        rows = regression_metrics(stacked, "_y", "_p", ["model"], gate_variant=True, blocks=blocks).withColumn("holdout", F.lit(holdout))
        out = rows if out is None else out.unionByName(rows)
    return out


def paired_errors(df: DataFrame, actual: str, champion: str, candidate: str) -> DataFrame:
    return df.withColumns({"champion_error": F.abs(F.col(actual) - F.col(champion)),
                           "candidate_error": F.abs(F.col(actual) - F.col(candidate))})


def windowed(df: DataFrame, size: int | None) -> tuple[DataFrame, list[str]]:
    """The frame with the number of each record's window, and the keys to group by; none without a size."""
    return (df, []) if size is None else (df.withColumn("window_index", F.floor(F.col("idx") / size)), ["window_index"])


def shadow_check(df: DataFrame, actual: str, champion: str, candidate: str, rows: int | None = None,
                 tolerance: float = 1.02, window: int | None = None) -> DataFrame:
    """Candidate beside champion on all records, or on those with an index below ``rows``; with ``window``, a verdict per so many records."""
    p = F.col(candidate)
    seen, keys = windowed(df if rows is None else df.filter(F.col("idx") < rows), window)
    pairs = paired_errors(seen, actual, champion, candidate)
    row = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg("champion_error").alias("champion_mae"),
        F.avg("candidate_error").alias("candidate_mae"), F.count_if(p.isNull()).alias("exceptions"),
        F.count_if(p <= 0).alias("non_positive"), F.count_if(p > 3600).alias("excessive"))
    out = row.withColumn("mae_ratio", ratio(F.col("candidate_mae"), F.col("champion_mae")))
    rules = {"no records": (F.col("sample_count") == 0) | F.col("candidate_mae").isNull(),
             "exceptions": F.col("exceptions") > 0, "non-positive predictions": F.col("non_positive") > 0,
             "excessive predictions": F.col("excessive") > 0, "MAE ratio": F.col("mae_ratio") > tolerance}
    return out.withColumn("failure_reasons", reasons(rules)).withColumn(
        "passed", F.when(F.col("failure_reasons") == "", 1).otherwise(0).cast("long"))


def canary_stage(df: DataFrame, percent: int, actual: str, champion: str, candidate: str, trip: str = "trip_id",
                 ts: str = "timestamp_utc", start: int = 0, rows: int | None = None, tolerance: float = 1.05,
                 min_samples: int = 15, blocks: dict[str, OrderBlocks] | None = None, window: int | None = None) -> DataFrame:
    """Both models on the hash-routed trips of a stage's records: all of them, unless ``start`` or ``rows`` bound their index.
    With ``window``, a verdict per so many records, those without a routed one too."""
    stage = df.filter(F.col("idx") >= start) if start else df
    stage, keys = windowed(stage if rows is None else stage.filter(F.col("idx") < start + rows), window)
    pairs = paired_errors(stage, actual, champion, candidate).withColumn("_routed", hash_route(F.col(trip), percent))
    row = summarize(pairs.filter("_routed"), keys, {
        "selected_records": F.count(F.lit(1)), "unique_trips": F.count_distinct(trip),
        "time_range_start": F.min(ts), "time_range_end": F.max(ts),
        "champion_mae": F.avg("champion_error"), "candidate_mae": F.avg("candidate_error"),
        "champion_rmse": F.sqrt(F.avg(F.col("champion_error") * F.col("champion_error"))),
        "candidate_rmse": F.sqrt(F.avg(F.col("candidate_error") * F.col("candidate_error"))),
        "unmatched_records": F.count_if(F.col("champion_error").isNull() != F.col("candidate_error").isNull()),
    }, {"champion_p95": ("champion_error", 0.95), "candidate_p95": ("candidate_error", 0.95)}, blocks)
    if keys:
        row = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_records")).join(row, keys, "left").fillna(
            0, ["selected_records", "unique_trips", "unmatched_records"])
    else:
        row = row.withColumn("total_records", pairs.agg(F.count(F.lit(1))).scalar())
    out = row.withColumns({"canary_percentage": F.lit(percent).cast("long"), "mae_ratio": ratio(F.col("candidate_mae"), F.col("champion_mae"))})
    rules = {"record ids differ": (F.col("unmatched_records") > 0) | (F.col("selected_records") == 0),
             "too few samples": F.col("selected_records") < min_samples, "MAE ratio": F.col("mae_ratio") > tolerance}
    return out.withColumn("failure_reasons", reasons(rules)).withColumn(
        "passed", F.when(F.col("failure_reasons") == "", 1).otherwise(0).cast("long"))


def watchdog_windows(evaluations: DataFrame, baseline_mae: float = 38.77, size: int = 500, max_ratio: float = 1.25,
                     max_latency_ms: float = 20.0, latency: str | None = None, exception: str | None = None) -> DataFrame:
    """Whether each window of ``size`` evaluations after a promotion, the last incomplete one too, calls for a rollback."""
    rows, keys = windowed(evaluations, size)
    out = rows.groupBy(*keys).agg(
        F.count("absolute_error_sec").alias("samples"), F.avg("absolute_error_sec").alias("observed_mae"),
        (F.coalesce(F.avg(latency), F.lit(0.0)) if latency else F.lit(0.0)).alias("avg_latency_ms"),
        (F.count_if(F.col(exception)) if exception else F.lit(0)).cast("long").alias("exceptions"),
    ).withColumn("mae_ratio", F.coalesce(F.col("observed_mae") / baseline_mae, F.lit(0.0)))
    rules = {"MAE": F.col("mae_ratio") > max_ratio, "latency": F.col("avg_latency_ms") > max_latency_ms,
             "exceptions": F.col("exceptions") > 0}
    why = F.when(F.col("samples") > 0, reasons(rules)).otherwise("")
    return out.withColumn("rollback_reason", why).withColumn(
        "rollback_triggered", F.when(F.col("rollback_reason") == "", 0).otherwise(1).cast("long"))


def watchdog(evaluations: DataFrame, baseline_mae: float = 38.77, size: int = 500, max_ratio: float = 1.25,
             max_latency_ms: float = 20.0, latency: str | None = None, exception: str | None = None) -> DataFrame:
    """One row: the first window that calls for a rollback, or else the last one, with the number of windows judged and tripped.

    Every window of ``size`` records is judged by itself, so a bad stretch isn't averaged away by good records around it.
    Without evaluations there is nothing to roll back: 0 samples, not triggered.
    """
    windows = watchdog_windows(evaluations, baseline_mae, size, max_ratio, max_latency_ms, latency, exception)
    whole = F.struct(*windows.columns)
    chosen = F.coalesce(F.min_by(whole, F.when(F.col("rollback_triggered") == 1, F.col("window_index"))), F.max_by(whole, "window_index"))
    row = windows.agg(chosen.alias("w"), F.count(F.lit(1)).alias("windows"), F.coalesce(F.sum("rollback_triggered"), F.lit(0)).alias("tripped_windows"))
    return row.select("w.*", "windows", "tripped_windows").fillna(0, ["samples", "exceptions", "rollback_triggered"]).fillna("", ["rollback_reason"])
