"""Profiling and validation reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.quantiles import summarize
from fleetlens.columns import melt

QUANTILE_NAMES = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def null_report(df: DataFrame) -> DataFrame:
    """Null count and percentage per column, one scan."""
    total = F.count(F.lit(1))
    row = df.agg(total.alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = row.unpivot(["_n"], df.columns, "column_name", "missing_count")
    return long.select("column_name", "missing_count",
                       (F.col("missing_count") * 100.0 / F.nullif(F.col("_n"), F.lit(0))).alias("missing_pct"))


def duplicate_report(df: DataFrame) -> DataFrame:
    """Occurrences after the first of fully equal rows."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    return groups.agg(
        F.sum("_c").alias("total_rows"),
        F.sum(F.col("_c") - 1).alias("duplicate_count"),
        (F.sum(F.col("_c") - 1) * 100.0 / F.sum("_c")).alias("duplicate_pct"),
    )


def outside(column: str, low: float, high: float) -> Column:
    """Out of [low, high]; missing values are not counted as outside."""
    return (F.col(column) < low) | (F.col(column) > high)


def coordinate_violations(lat: str, lon: str, lat_bounds, lon_bounds) -> Column:
    return outside(lat, *lat_bounds) | outside(lon, *lon_bounds)


def bounds_report(df: DataFrame, condition: Column, name: str) -> DataFrame:
    """Rows that break a rule and their share."""
    return df.agg(F.count_if(condition).alias(name),
                  (F.count_if(condition) * 100.0 / F.count(F.lit(1))).alias(f"{name}_pct"))


def timestamp_report(df: DataFrame, column: str) -> DataFrame:
    numeric = dict(df.dtypes)[column] in {"bigint", "int", "double", "float", "smallint"}
    return df.agg(F.lit(column).alias("column_name"), F.lit(int(numeric)).cast("long").alias("is_numeric"),
                  F.min(column).alias("min_timestamp"), F.max(column).alias("max_timestamp"))


def delay_report(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.agg(F.count_if(outside(column, low, high)).alias("invalid_delay_count"),
                  F.avg(column).alias("mean_delay_sec"), F.stddev_samp(column).alias("std_delay_sec"))


def binary_flags_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per flag column: number of values other than 0 and 1."""
    row = df.agg(*[F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(0, 1)).alias(c) for c in columns])
    return row.unpivot([], columns, "column_name", "invalid_count").withColumn(
        "is_binary", F.when(F.col("invalid_count") == 0, 1).otherwise(0).cast("long"))


def validation_verdict(df: DataFrame, coords: Column, speed: Column, delay: Column, share: float = 0.10) -> DataFrame:
    """A table is invalid if it is empty or the three rule violations exceed a share of its rows."""
    row = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(coords).alias("out_of_bounds_coords_count"),
                 F.count_if(speed).alias("impossible_speed_count"), F.count_if(delay).alias("invalid_delay_count"))
    bad = F.col("out_of_bounds_coords_count") + F.col("impossible_speed_count") + F.col("invalid_delay_count")
    ok = (F.col("total_rows") > 0) & (bad <= F.col("total_rows") * share)
    return row.withColumn("is_valid", F.when(ok, 1).otherwise(0).cast("long"))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break any rule, with the names of the broken rules."""
    names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return df.withColumn("broken_rules", F.concat_ws(",", names)).filter(F.col("broken_rules") != "")


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """count/mean/median/min/max/sample std of several columns in long form."""
    long = melt(df, [], columns, "column_name", "value")
    return summarize(
        long, ["column_name"],
        {"non_null": F.count("value"), "mean": F.avg("value"), "min": F.min("value"), "max": F.max("value"),
         "std": F.stddev_samp("value")},
        {"median": ("value", 0.5)},
    )


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column.  Long form keeps it one (column, value) shuffle."""
    if approximate:
        return df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).unpivot(
            [], columns, "column_name", "distinct_count")
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column_name", "v")
    return (long.filter(F.col("v").isNotNull()).distinct().groupBy("column_name")
            .agg(F.count(F.lit(1)).alias("distinct_count")))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values as rows."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def extent(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum and maximum of columns side by side (dates, coordinates)."""
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def distribution_table(df: DataFrame, columns: list[str], quantiles: dict[str, float] | None = None) -> DataFrame:
    """Mean, std and quantiles per column, the reference point of later drift checks."""
    quantiles = quantiles or QUANTILE_NAMES
    long = melt(df, [], columns, "column_name", "value")
    return summarize(long, ["column_name"],
                     {"mean": F.avg("value"), "std": F.stddev_samp("value"), "max": F.max("value")},
                     {n: ("value", p) for n, p in quantiles.items()})


def quality_dashboard(stages: dict[str, DataFrame], clean: DataFrame, trip: str, device: str, ts: str,
                      matched: str) -> DataFrame:
    """(metric, value) rows: row count per stage, uniques, time range, weather match rate."""
    counts = [df.agg(F.count(F.lit(1)).cast("double").alias("value"))
              .select(F.lit(f"rows_{name}").alias("metric"), "value") for name, df in stages.items()]
    facts = clean.agg(
        F.count_distinct(trip).cast("double").alias("unique_trips"),
        F.count_distinct(device).cast("double").alias("unique_devices"),
        F.unix_micros(F.min(ts).cast("timestamp")).cast("double").alias("first_micros"),
        F.unix_micros(F.max(ts).cast("timestamp")).cast("double").alias("last_micros"),
        (F.count(matched) * 100.0 / F.count(F.lit(1))).alias("weather_match_pct"),
    )
    facts = facts.unpivot([], facts.columns, "metric", "value")
    return reduce(DataFrame.unionByName, [*counts, facts])


def scan_profile(df: DataFrame, distinct: list[str]) -> DataFrame:
    """Rows, nulls over all columns and distinct counts in one aggregation."""
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("total_rows"), nulls.alias("null_cells"),
                  *[F.count_distinct(c).alias(f"distinct_{c}") for c in distinct])
