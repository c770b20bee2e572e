"""Cleaning rules and the one-pass audit trail."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN_TIME_KEYS = ["trip_id", "deviceid", "direction", "segment", "date", "start_time", "run_time_in_seconds"]
RUN_TIME_BOUNDS = (3.0, 3600.0)
DUPLICATE_STAGE = "duplicate_removal"


@dataclass(frozen=True)
class Rule:
    """A named condition a row must meet; NULL counts as not met."""

    stage: str
    keep: Column
    reason: str


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicates, NULL equal to NULL.  Grouping by every column spreads copies map-side."""
    return df.dropDuplicates()


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def within(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.filter(F.col(column).between(low, high))


def within_box(df: DataFrame, lat: str, lon: str, lat_bounds, lon_bounds) -> DataFrame:
    return df.filter(F.col(lat).between(*lat_bounds) & F.col(lon).between(*lon_bounds))


def parsed_time(date: str = "date", start: str = "start_time") -> Column:
    """Timestamp of a date and a clock time; unparsable text gives NULL."""
    day = F.try_to_timestamp(F.col(date), F.lit("yyyy-MM-dd"))
    text = F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.col(start))
    return F.when(day.isNotNull() & F.col(start).isNotNull(), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def parse_times(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp_utc", parsed_time()).filter(F.col("timestamp_utc").isNotNull())


def normalize_ids(df: DataFrame, route_id: str = "654") -> DataFrame:
    """Ids read as floats become integer text; direction and segment become integers."""
    as_text = {c: F.col(c).cast("long").cast("string") for c in ("trip_id", "deviceid")}
    as_int = {c: F.col(c).cast("int") for c in ("direction", "segment")}
    return df.withColumns({**as_text, **as_int, "route_id": F.lit(route_id)})


def run_time_rules() -> list[Rule]:
    present = F.lit(True)
    for c in RUN_TIME_KEYS:
        present = present & F.col(c).isNotNull()
    return [
        Rule("missing_attributes_filter", present, "Missing key attributes"),
        Rule("timestamp_parsing", parsed_time().isNotNull(), "Malformed date or start_time strings"),
        Rule("run_time_bounds", F.col("run_time_in_seconds").between(*RUN_TIME_BOUNDS), "Run time outside bounds"),
    ]


def position_rules(lat_bounds, lon_bounds, speed_bounds) -> list[Rule]:
    return [
        Rule("timestamp_filter", F.col("timestamp_utc").isNotNull(), "Missing timestamp"),
        Rule("coordinate_filter",
             F.col("latitude").between(*lat_bounds) & F.col("longitude").between(*lon_bounds), "Outside the area"),
        Rule("speed_filter", F.col("current_speed_kmh").between(*speed_bounds), "Impossible speed"),
        Rule("route_trip_filter", F.col("route_id").isNotNull() & F.col("trip_id").isNotNull(), "Missing route or trip"),
        Rule("stop_filter", F.col("stop_id").isNotNull(), "Missing stop"),
    ]


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Deduplicate, then keep the rows that meet every rule."""
    out = drop_duplicates(df)
    for rule in rules:
        out = out.filter(rule.keep)
    return out


def clean_run_times(df: DataFrame, route_id: str = "654") -> DataFrame:
    kept = apply_rules(df, run_time_rules()).withColumn("timestamp_utc", parsed_time())
    return normalize_ids(kept, route_id)


def audit_trail(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Removed and remaining rows per stage in one pass over the data.

    Each distinct row gets the number of the first rule it fails; its copies are
    the duplicate stage.  The stage table is tiny, so its running sum may sort in one task.
    """
    failing = F.lit(len(rules) + 1)
    for number, rule in reversed(list(enumerate(rules, 1))):
        failing = F.when(F.coalesce(rule.keep, F.lit(False)), failing).otherwise(F.lit(number))
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    fails = groups.select(failing.alias("_stage"), "_copies")
    row = fails.agg(
        F.sum("_copies").alias("_initial"),
        F.sum(F.col("_copies") - 1).alias("_removed_0"),
        *[F.count_if(F.col("_stage") == i).alias(f"_removed_{i}") for i in range(1, len(rules) + 1)],
    )
    stages = [(0, DUPLICATE_STAGE, "Exact duplicate rows")] + [(i, r.stage, r.reason) for i, r in enumerate(rules, 1)]
    long = row.select("_initial", F.explode(F.array(*[
        F.struct(F.lit(i).cast("long").alias("stage_number"), F.lit(name).alias("stage"), F.lit(reason).alias("reason"),
                 F.col(f"_removed_{i}").cast("long").alias("records_removed")) for i, name, reason in stages
    ])).alias("s")).select("_initial", "s.*")
    removed = F.sum("records_removed").over(
        Window.orderBy("stage_number").rowsBetween(Window.unboundedPreceding, 0))
    return long.select(
        "stage_number", "stage", "reason",
        (F.col("_initial") - removed + F.col("records_removed")).alias("records_before"),
        "records_removed", (F.col("_initial") - removed).alias("records_remaining"))


def retention(initial: DataFrame, clean: DataFrame, trip: str, device: str, ts: str) -> DataFrame:
    """Retention percentage with the uniques and time range of what is kept."""
    before = initial.agg(F.count(F.lit(1)).alias("initial_records"))
    kept = clean.agg(F.count(F.lit(1)).alias("final_records"), F.count_distinct(trip).alias("unique_trips"),
                     F.count_distinct(device).alias("unique_devices"),
                     F.min(ts).alias("start_time"), F.max(ts).alias("end_time"))
    return kept.select(before.scalar().alias("initial_records"), "*").withColumn(
        "retention_rate_pct", F.col("final_records") * 100.0 / F.nullif(F.col("initial_records"), F.lit(0)))


def chronological(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Total order for a sink: a range-partitioned sort."""
    return df.orderBy(*order)
