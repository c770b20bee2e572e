"""Training targets and their audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.columns import seconds_between
from fleetlens.operators.quality import QUANTILE_NAMES
from fleetlens.ordering import Ordered, OrderBlocks
from fleetlens.quantiles import summarize
from fleetlens.schemas import TARGET

NEXT_RECORD_BOUNDS = (1.0, 3600.0)
RUN_TIME_BOUNDS = (3.0, 3600.0)


def time_to_next_record(df: DataFrame, order: Sequence[str], trip: str = "trip_id", ts: str = "timestamp_utc",
                        blocks: OrderBlocks | None = None) -> DataFrame:
    """Seconds until the next record of the trip; the last record has none."""
    ahead = Ordered(df, [trip], list(order), blocks).lead(ts, "actual_next_stop_arrival_utc").frame()
    return ahead.withColumn(TARGET, seconds_between(F.col("actual_next_stop_arrival_utc"), F.col(ts)))


def time_to_arrival(df: DataFrame, arrival: str = "next_stop_arrival_utc", ts: str = "timestamp_utc") -> DataFrame:
    return df.withColumn(TARGET, seconds_between(F.col(arrival), F.col(ts)))


def run_time_target(df: DataFrame, run_time: str = "run_time_in_seconds") -> DataFrame:
    return df.withColumn(TARGET, F.col(run_time).cast("double"))


def rejections(df: DataFrame, bounds=NEXT_RECORD_BOUNDS, lower_inclusive: bool = True) -> DataFrame:
    """Rejected labels per reason.

    With ``lower_inclusive`` a label equal to the minimum is counted as rejected
    although ``valid_labels`` keeps it; the two counts overlap by those rows.
    """
    y = F.col(TARGET)
    low: Column = (y <= bounds[0]) if lower_inclusive else (y < bounds[0])
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(y.isNull()).alias("missing_label"),
                  F.count_if(low).alias("too_small"), F.count_if(y > bounds[1]).alias("too_large"),
                  F.count_if(y.between(*bounds)).alias("valid_rows"))


def valid_labels(df: DataFrame, bounds=NEXT_RECORD_BOUNDS) -> DataFrame:
    return df.filter(F.col(TARGET).between(*bounds))


def label_distribution(df: DataFrame) -> DataFrame:
    """Count, moments and percentiles of the label; zeros for an empty table."""
    y = F.col(TARGET)
    aggregates = {"count": F.count(y), "mean_sec": F.avg(y), "std_sec": F.stddev_samp(y),
                  "min_sec": F.min(y), "max_sec": F.max(y)}
    quantiles = {"median_sec": (TARGET, 0.5), **{f"{n}_sec": (TARGET, p) for n, p in QUANTILE_NAMES.items()}}
    out = summarize(df, [], aggregates, quantiles)
    return out.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in out.columns])
