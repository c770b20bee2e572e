"""Prediction error metrics and breakdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.columns import round_to
from fleetlens.functions import labels as L
from fleetlens.ordering import OrderBlocks
from fleetlens.quantiles import cumulative_counts, summarize

EXCESSIVE_SEC = 3600.0
MIN_PERCENT_TARGET = 10.0
ERROR_QUANTILES = {"median_ae_sec": 0.5, "p90_error_sec": 0.90, "p95_error_sec": 0.95, "p99_error_sec": 0.99}


def with_errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """signed = actual - predicted, and absolute error."""
    e = F.col(actual) - F.col(predicted)
    return df.withColumns({"signed_error_sec": e, "absolute_error_sec": F.abs(e)})


def percent_error(actual: str = "actual", error: str = "absolute_error_sec", floor: float = MIN_PERCENT_TARGET) -> Column:
    return F.col(error) / F.greatest(F.col(actual), F.lit(floor)) * 100.0


def regression_metrics(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = (),
                       gate_variant: bool = False, blocks: dict[str, OrderBlocks] | None = None) -> DataFrame:
    """Error metrics, one row per key.

    ``gate_variant`` takes sMAPE over targets of at least 10 s and counts only
    predictions strictly above an hour as excessive.
    """
    rows = with_errors(df, actual, predicted)
    y, p, e = F.col(actual), F.col(predicted), F.col("absolute_error_sec")
    denominator = F.abs(y) + F.abs(p)
    usable = y >= MIN_PERCENT_TARGET
    if gate_variant:
        smape = F.avg(F.when(usable, 2.0 * e / F.when(denominator == 0, 1.0).otherwise(denominator))) * 100.0
        excessive = p > EXCESSIVE_SEC
        no_target = F.lit(0.0)
    else:
        smape = F.avg(F.when(denominator > 1e-6, 2.0 * e / denominator)) * 100.0
        excessive = p >= EXCESSIVE_SEC
        no_target = F.lit(None).cast("double")
    n = F.count(F.lit(1))
    aggregates = {
        "samples": n,
        "mae_sec": F.avg(e),
        "rmse_sec": F.sqrt(F.avg(e * e)),
        "r2": 1.0 - F.avg(e * e) / F.nullif(F.var_pop(y), F.lit(0.0)),
        "mape_pct": F.coalesce(F.avg(F.when(usable, e / y)) * 100.0, no_target),
        "smape_pct": F.coalesce(smape, F.lit(0.0)),
        "non_positive_count": F.count_if(p <= 0),
        "non_positive_pct": F.count_if(p <= 0) * 100.0 / n,
        "excessive_count": F.count_if(excessive),
        "excessive_pct": F.count_if(excessive) * 100.0 / n,
    }
    quantiles = {name: ("absolute_error_sec", share) for name, share in ERROR_QUANTILES.items()}
    return summarize(rows, list(keys), aggregates, quantiles, blocks)


def error_dimensions(df: DataFrame) -> DataFrame:
    """Report labels of the nine breakdown dimensions."""
    return df.withColumns({
        "direction_name": L.direction_label(F.col("direction")),
        "segment_name": L.segment_label(F.col("segment")),
        "hour_name": L.hour_label(F.col("hour")),
        "weekday_name": L.weekday_label(F.col("day_of_week")),
        "peak_name": L.peak_label(F.col("is_peak_period")),
        "weather_name": L.weather_label(F.col("weather_code")),
        "precipitation_tier": L.right_closed(F.col("precipitation"), *L.PRECIPITATION_TIERS),
        "congestion_tier": L.right_closed(F.col("congestion_proxy"), *L.CONGESTION_TIERS),
        "target_range": L.right_closed(F.col("actual"), *L.TARGET_TIERS),
    })


BREAKDOWNS = {
    "by_direction": "direction_name", "by_segment": "segment_name", "by_hour": "hour_name",
    "by_day_of_week": "weekday_name", "by_peak_period": "peak_name", "by_weather_condition": "weather_name",
    "by_precipitation_tier": "precipitation_tier", "by_congestion_tier": "congestion_tier",
    "by_target_range": "target_range",
}


def stratified_errors(df: DataFrame, breakdowns: dict[str, str] | None = None,
                      blocks: dict[str, OrderBlocks] | None = None) -> DataFrame:
    """Error metrics per value of every dimension.

    Rows become (dimension, label, errors) and are aggregated once; partial
    aggregation leaves only one row per label and task for the shuffle.
    """
    breakdowns = breakdowns or BREAKDOWNS
    rows = error_dimensions(with_errors(df, "actual", "predicted")).withColumn("pct_error", percent_error())
    measures = ["absolute_error_sec", "pct_error", "actual", "predicted"]
    long = rows.select(*measures, *breakdowns.values()).unpivot(
        measures, list(breakdowns.values()), "column_name", "label").filter(F.col("label").isNotNull())
    dimension = L.lookup(F.col("column_name"), {c: d for d, c in breakdowns.items()}, "")
    e = F.col("absolute_error_sec")
    return summarize(
        long.withColumn("dimension", dimension), ["dimension", "label"],
        {"records": F.count(F.lit(1)), "mae_sec": F.avg(e), "rmse_sec": F.sqrt(F.avg(e * e)),
         "mape_pct": F.avg("pct_error"), "mean_actual_sec": F.avg("actual"), "mean_pred_sec": F.avg("predicted")},
        {"median_ae_sec": ("absolute_error_sec", 0.5), "p90_error_sec": ("absolute_error_sec", 0.9)}, blocks)


def mae_by(df: DataFrame, key: str) -> DataFrame:
    rows = with_errors(df, "actual", "predicted")
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("records"), F.avg("absolute_error_sec").alias("mae_sec"))


def actual_vs_predicted(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Per-row comparison table with rounded errors."""
    rows = with_errors(df, "actual", "predicted")
    return rows.select(
        *ids, "actual", round_to(F.col("predicted"), 2).alias("predicted"),
        round_to(F.col("signed_error_sec"), 2).alias("signed_error_sec"),
        round_to(F.col("absolute_error_sec"), 2).alias("absolute_error_sec"),
        round_to(percent_error(), 2).alias("percentage_error"))


def residual_histogram(df: DataFrame, low: float = -150.0, high: float = 150.0, bins: int = 80) -> DataFrame:
    """Equal-width bins of actual - predicted; rows outside the range are left out, as in a density plot."""
    width = (high - low) / bins
    r = F.col("actual") - F.col("predicted")
    inside = df.select(r.alias("r")).filter(F.col("r").between(low, high))
    number = F.least(F.floor((F.col("r") - low) / width), F.lit(bins - 1)).cast("long")
    counts = inside.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("records"))
    total = F.sum("records").over(Window.partitionBy())
    return counts.select("bin", (F.lit(low) + F.col("bin") * width).alias("bin_start"), "records",
                         (F.col("records") / (total * width)).alias("density"))


def residual_center(df: DataFrame, blocks: dict[str, OrderBlocks] | None = None) -> DataFrame:
    rows = df.select((F.col("actual") - F.col("predicted")).alias("r"))
    return summarize(rows, [], {"mean_residual": F.avg("r")}, {"median_residual": ("r", 0.5)}, blocks)


def error_cdf(df: DataFrame, blocks: OrderBlocks | None = None) -> DataFrame:
    """Distinct absolute errors with the share of rows at or below."""
    rows = with_errors(df, "actual", "predicted").select("absolute_error_sec")
    cum = cumulative_counts(rows, [], "absolute_error_sec", {"records": F.lit(1)}, blocks)
    return cum.select("absolute_error_sec", "records", (F.col("cum_records") / F.col("all_records")).alias("cdf"))


def error_buckets(df: DataFrame) -> DataFrame:
    rows = with_errors(df, "actual", "predicted")
    bucket = L.left_closed(F.col("absolute_error_sec"), *L.ERROR_BUCKETS)
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("records"))


def scatter_sample(df: DataFrame, key: str, size: int = 5000) -> DataFrame:
    """Repeatable sample of at most ``size`` rows: the smallest key digests."""
    return df.withColumn("_h", F.md5(F.col(key).cast("string").cast("binary"))).orderBy("_h", key).limit(size).drop("_h")


def leading_slice(df: DataFrame, order: Sequence[str], size: int = 150) -> DataFrame:
    return df.orderBy(*order).limit(size)
