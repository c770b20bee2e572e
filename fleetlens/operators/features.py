"""Model inputs from cleaned, weather-joined run times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.columns import clip, flag, melt, resolve, with_default
from fleetlens.functions.calendar import cycle, is_peak, minute_of_day
from fleetlens.functions.geo import haversine_km
from fleetlens.ordering import Ordered, OrderBlocks, order_blocks, small_like
from fleetlens.quantiles import exact_quantiles
from fleetlens.schemas import CATEGORICAL_FEATURES, NUMERICAL_FEATURES, TARGET, WEATHER_FEATURES

CONGESTION_RATIO = 1.25
RATIO_BOUNDS = (0.2, 5.0)
DWELL_AT_STOP_SEC = 20.0

# fixed values: names that must never be model inputs
FORBIDDEN_COLUMNS = [
    "eta_to_next_stop_sec", "run_time_in_seconds", "future_segment_run_time", "future_dwell_time",
    "future_arrival_time", "future_timestamp", "actual_eta_sec", "target", "y",
]
FORBIDDEN_SUBSTRINGS = ["future", "next_segment_run", "next_dwell", "next_arrival", "actual_run_time"]


class LeakageError(ValueError):
    """A model input would reveal the label or the future."""


def calendar_features(df: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    """hour, minute, Monday-0 weekday and weekend flag."""
    t = F.col(ts)
    return df.withColumns({"hour": F.hour(t), "minute": F.minute(t), "day_of_week": F.weekday(t),
                           "is_weekend": flag(F.weekday(t) >= 5)})


def cyclical_features(df: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    sin_h, cos_h = cycle(F.hour(F.col(ts)), 24)
    sin_d, cos_d = cycle(minute_of_day(F.col(ts)), 1440)
    return df.withColumns({"sin_hour": sin_h, "cos_hour": cos_h, "sin_time_of_day": sin_d, "cos_time_of_day": cos_d})


def peak_feature(df: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    return df.withColumn("is_peak_period", flag(is_peak(F.col(ts))))


def distance_features(df: DataFrame) -> DataFrame:
    """Distance to the next stop and along the rest of the route."""
    out = df
    if "distance_to_next_stop_km" not in df.columns:
        away = haversine_km(F.col("latitude"), F.col("longitude"), F.col("next_stop_lat"), F.col("next_stop_lon"))
        out = out.withColumn("distance_to_next_stop_km", F.coalesce(away, F.lit(0.0)))
    if "distance_remaining_on_route_km" not in df.columns:
        length = F.col("segment_distance_km") if "segment_distance_km" in df.columns else F.lit(1.0)
        stops = F.col("stops_remaining") if "stops_remaining" in df.columns else F.lit(1)
        out = out.withColumn("distance_remaining_on_route_km", length * stops)
    return out


def _trailing(columns: Sequence[Column]) -> dict[str, Column]:
    """mean, sample std, min and max of the values that exist among a few columns."""
    values = F.array_compact(F.array(*columns))
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
    spread = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return {"mean": mean, "std": F.when(n > 1, F.sqrt(spread / (n - 1))).otherwise(0.0),
            "min": F.array_min(values), "max": F.array_max(values)}


def rolling_speed(df: DataFrame, order: Sequence[str], speed: str = "current_speed_kmh", trip: str = "trip_id",
                  include_current: bool = True, blocks: OrderBlocks | None = None) -> DataFrame:
    """Trailing-3 speed statistics within the trip, by default with the current row."""
    first = 0 if include_current else 1
    seq = Ordered(df, [trip], list(order), blocks)
    names = []
    for k in range(first, first + 3):
        if k:
            seq = seq.lag(speed, k, f"_speed_{k}")
        names.append(f"_speed_{k}" if k else speed)
    stats = _trailing([F.col(n) for n in names])
    return seq.frame().withColumns({f"recent_speed_{n}": e for n, e in stats.items()}).drop(
        *[n for n in names if n != speed])


def _progress(placed: DataFrame) -> DataFrame:
    return placed.withColumns({
        "segments_completed": F.col("_rn") - 1,
        "segments_remaining": F.col("_total") - F.col("_rn"),
        "trip_progress_ratio": clip((F.col("_rn") - 1) / F.col("_total"), 0.0, 1.0),
    }).drop("_one", "_rn", "_total")


def trip_progress(df: DataFrame, order: Sequence[str], trip: str = "trip_id",
                  blocks: OrderBlocks | None = None) -> DataFrame:
    """Segments completed and remaining, and the share of the trip behind the vehicle."""
    seq = Ordered(df.withColumn("_one", F.lit(1)), [trip], list(order), blocks).row_number("_rn")
    return _progress(seq.total("count", "_one", "_total").frame())


def segment_history(df: DataFrame, run_time: str = "run_time_in_seconds", causal: bool = False,
                    order: Sequence[str] = (), blocks: OrderBlocks | None = None) -> DataFrame:
    """Mean run time of the (direction, segment).

    The default mean covers the whole table, so a row's own label is part of it.
    ``causal`` uses earlier rows only and is NULL for the first row of a segment.
    """
    keys = ["direction", "segment"]
    if causal:
        seen = Ordered(df.withColumn("_one", F.lit(1.0)), keys, list(order), blocks).running_sum(
            run_time, "_s").running_sum("_one", "_n").frame()
        before = F.try_divide(F.col("_s") - F.col(run_time), F.col("_n") - 1)
        return seen.withColumn("historical_segment_time_mean", before).drop("_one", "_s", "_n")
    means = df.groupBy(*keys).agg(F.avg(run_time).alias("historical_segment_time_mean"))
    return df.join(means, keys)


def _fill_and_roll(first: DataFrame, order: Sequence[str], trip: str, blocks: OrderBlocks | None) -> DataFrame:
    name = "previous_segment_run_time"
    filled = first.withColumn(name, F.coalesce("_previous", "historical_segment_time_mean")).drop("_previous")
    seq = Ordered(filled, [trip], list(order), blocks).lag(name, 1, "_p1").lag(name, 2, "_p2")
    rolled = seq.running_sum(name, "_run").frame()
    stats = _trailing([F.col(name), F.col("_p1"), F.col("_p2")])
    return rolled.withColumns({
        "rolling_prev_segment_mean": stats["mean"], "rolling_prev_segment_std": stats["std"],
        "cumulative_trip_time_sec": F.greatest(F.col("_run") - F.col(name), F.lit(0.0)),
    }).drop("_p1", "_p2", "_run")


def preceding_run_times(df: DataFrame, order: Sequence[str], trip: str = "trip_id",
                        run_time: str = "run_time_in_seconds", blocks: OrderBlocks | None = None) -> DataFrame:
    """Previous run time (segment mean on the first row), its trailing-3 mean and std, and time so far."""
    first = Ordered(df, [trip], list(order), blocks).lag(run_time, 1, "_previous").frame()
    return _fill_and_roll(first, order, trip, blocks)


def delay_features(df: DataFrame) -> DataFrame:
    """Previous run time relative to this segment's mean, and the congestion flag."""
    mean = F.col("historical_segment_time_mean")
    ratio = F.col("previous_segment_run_time") / F.when(mean == 0, 1.0).otherwise(mean)
    return df.withColumn("segment_delay_ratio", clip(ratio, *RATIO_BOUNDS)).withColumn(
        "congestion_proxy", flag(F.col("segment_delay_ratio") > CONGESTION_RATIO))


def impute_median(df: DataFrame, columns: Sequence[str] = tuple(WEATHER_FEATURES),
                  source: DataFrame | None = None, blocks: OrderBlocks | None = None) -> DataFrame:
    """Fill nulls with the column's exact median; 0 for an all-null or absent column.

    The medians come from one long-form pass and enter the plan as scalar subqueries.
    ``source`` may be a cheaper frame with the same values.
    """
    present = [c for c in columns if c in df.columns]
    out = df.withColumns({c: F.lit(0.0) for c in columns if c not in present})
    if not present:
        return out
    long = melt(source if source is not None else df, [], present).withColumn("_all", F.lit(1))
    medians = exact_quantiles(long, ["feature"], "value", {"median": 0.5}, blocks)
    row = medians.agg(*[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(c) for c in present])
    wide = row.select(F.struct(*present).alias("m")).scalar()
    return out.withColumns({
        c: F.coalesce(F.col(c).cast("double"), wide.getField(c), F.lit(0.0)) for c in present})


def optional_defaults(df: DataFrame) -> DataFrame:
    """Constants for optional columns, and the dwell default at a stop."""
    defaults = {"direction_id": 0, "stop_sequence": 1, "stops_remaining": 0, "current_speed_kmh": 25.0,
                "is_at_stop": 0, "is_congested": 0, "simulated_passenger_occupancy_ratio": 0.35,
                "injected_disturbance_intensity": 0.0, "is_incident_active": 0}
    out = df
    for name, value in defaults.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(value))
    if "dwell_time_sec" not in out.columns:
        out = out.withColumn("dwell_time_sec", F.when(F.col("is_at_stop") == 1, DWELL_AT_STOP_SEC).otherwise(0.0))
    for name in ("temperature_2m", "precipitation", "rain", "wind_speed_10m", "weather_code"):
        out = with_default(out, name, 0.0)
    return out


def run_time_features(df: DataFrame, order: Sequence[str] = ("timestamp_utc", "segment"),
                      blocks: OrderBlocks | None = None, impute_from: DataFrame | None = None) -> DataFrame:
    """All 29 model inputs for cleaned run times."""
    out = peak_feature(cyclical_features(calendar_features(df)))
    length = resolve(df, ["length", "segment_length_km"])
    out = out.withColumn("segment_length_km", F.col(length).cast("double"))
    out = segment_history(out)
    blocks = (blocks or order_blocks(df, order[0])).settle(df, ["trip_id"])
    placed = Ordered(out.withColumn("_one", F.lit(1)), ["trip_id"], list(order), blocks).row_number("_rn").total(
        "count", "_one", "_total").lag("run_time_in_seconds", 1, "_previous").frame()
    out = delay_features(_fill_and_roll(_progress(placed), order, "trip_id", blocks))
    out = impute_median(out, source=impute_from, blocks=(small_like(blocks, "value") or {}).get("value"))
    check_feature_names(CATEGORICAL_FEATURES + NUMERICAL_FEATURES)
    return out.withColumn("deviceid", F.col("deviceid").cast("string"))


def name_violations(columns: Sequence[str]) -> list[str]:
    lowered = [(c, c.lower().strip()) for c in columns]
    return [c for c, low in lowered if low in FORBIDDEN_COLUMNS or any(s in low for s in FORBIDDEN_SUBSTRINGS)]


def check_feature_names(columns: Sequence[str], required: Sequence[str] = ()) -> None:
    """Fail before any work starts when an input may leak, or a required one is missing."""
    bad = name_violations(columns)
    if bad:
        raise LeakageError(f"columns reveal the label or the future: {', '.join(bad)}")
    missing = [c for c in required if c not in columns]
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")


def leakage_audit(df: DataFrame, features: Sequence[str], label: str = TARGET) -> DataFrame:
    """Per feature: name verdict, correlation with the label and share of equal rows."""
    long = melt(df.withColumn("_label", F.col(label).cast("double")), ["_label"], list(features))
    bad = name_violations(features)
    name_ok = F.when(F.col("feature").isin(bad), 0).otherwise(1) if bad else F.lit(1)
    return long.groupBy("feature").agg(
        F.corr("value", "_label").alias("label_correlation"),
        F.avg(F.when(F.col("value") == F.col("_label"), 1.0).otherwise(0.0)).alias("equal_share"),
    ).withColumn("name_allowed", name_ok.cast("long"))


# fixed values: where a model input comes from
PROVENANCE = {
    "REAL_DERIVED_CALENDAR": ["hour", "minute", "day_of_week", "is_weekend", "is_peak_period", "sin_hour", "cos_hour",
                              "sin_time_of_day", "cos_time_of_day"],
    "REAL_OBSERVED": ["segment_length_km"],
    "REAL_DERIVED_TRIP": ["segments_completed", "segments_remaining", "trip_progress_ratio",
                          "previous_segment_run_time", "rolling_prev_segment_mean", "rolling_prev_segment_std",
                          "cumulative_trip_time_sec", "historical_segment_time_mean", "segment_delay_ratio",
                          "congestion_proxy"],
    "REAL_WEATHER": list(WEATHER_FEATURES),
}


def feature_catalog(df: DataFrame, features: Sequence[str] = tuple(NUMERICAL_FEATURES)) -> DataFrame:
    """Data dictionary: provenance class, declared type and measured statistics per feature."""
    stats = melt(df, [], list(features)).groupBy("feature").agg(
        F.count("value").alias("non_null"), F.avg("value").alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    origin = F.lit("UNKNOWN")
    for label, names in PROVENANCE.items():
        origin = F.when(F.col("feature").isin(names), label).otherwise(origin)
    return stats.withColumn("provenance", origin).withColumn("feature_type", F.lit("numerical"))
