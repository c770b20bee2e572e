"""Schedules, stops and weather: joins and per-trip sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.columns import clip, flag, seconds_between
from fleetlens.functions.geo import clock_seconds, haversine_km
from fleetlens.functions.labels import lookup
from fleetlens.ordering import Ordered, OrderBlocks

# fixed values: direction names of the route table
ROUTE_DIRECTIONS = {"Kandy-Digana": 1, "Digana-Kandy": 2}
DEFAULT_SPEED_KMH = 25.0
SPEED_BOUNDS_KMH = (5.0, 75.0)
CONGESTED_BELOW_KMH = 15.0


def trips_with_routes(trips: DataFrame, routes: DataFrame) -> DataFrame:
    """No broadcast hint: Spark broadcasts the routes when their size allows it."""
    return trips.join(routes, "route_id")


def with_stop_times(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """The large join; adaptive execution splits trips that hold too many stop times."""
    return stop_times.join(trips, "trip_id")


def with_stop_positions(sequence: DataFrame, stops: DataFrame) -> DataFrame:
    return sequence.join(stops, "stop_id")


def first_trips(trips: DataFrame, n: int, order: str = "trip_id") -> DataFrame:
    """The first n trips in id order (a top-n, not a full sort)."""
    return trips.orderBy(order).limit(n)


def keep_first_trips(rows: DataFrame, n: int, trip: str = "trip_id") -> DataFrame:
    """All rows of the first n distinct trips."""
    chosen = rows.select(trip).distinct().orderBy(trip).limit(n)
    return rows.join(chosen, trip, "left_semi")


def stop_sequences(rows: DataFrame, order: Sequence[str], trip: str = "trip_id", sequence: str = "stop_sequence",
                   blocks: OrderBlocks | None = None) -> DataFrame:
    """Next stop, segment length, stops remaining and distance so far along every trip.

    Two ordered passes: the next stop first, then the running distance that needs it.
    """
    ahead = (
        Ordered(rows, [trip], list(order), blocks)
        .lead("stop_id", "next_stop_id").lead("stop_lat", "next_stop_lat").lead("stop_lon", "next_stop_lon")
        .total("max", sequence, "_last").frame()
    )
    length = haversine_km(F.col("stop_lat"), F.col("stop_lon"), F.col("next_stop_lat"), F.col("next_stop_lon"))
    measured = ahead.withColumns({
        "segment_distance_km": F.coalesce(length, F.lit(0.0)),
        "stops_remaining": F.col("_last") - F.col(sequence),
    }).drop("_last")
    return Ordered(measured, [trip], list(order), blocks).running_sum(
        "segment_distance_km", "cumulative_distance_km").frame()


def route_topology(stops: DataFrame, order: Sequence[str] = ("stop_id",), blocks: OrderBlocks | None = None) -> DataFrame:
    """Direction numbers from names (unknown is 1) and stop numbers within a direction."""
    typed = stops.withColumn("direction_id", lookup(F.col("direction"), ROUTE_DIRECTIONS, 1).cast("int")).withColumn(
        "route_id", F.col("route_id").cast("string"))
    return Ordered(typed, ["direction_id"], list(order), blocks).row_number("stop_sequence").frame()


def expand_service_days(rows: DataFrame, first: str, last: str, arrival: str = "arrival_time") -> DataFrame:
    """One copy of the schedule per service day, with arrival timestamps.

    The day list is generated per row, so there is no join and no second table.
    """
    day = F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("INTERVAL 1 DAY")))
    dated = rows.withColumn("arrival_sec", clock_seconds(F.col(arrival))).withColumn("service_date", day)
    return dated.withColumn(
        "timestamp_utc",
        F.timestamp_seconds(F.unix_timestamp(F.col("service_date").cast("timestamp")) + F.col("arrival_sec")))


def vehicle_id(block_column: str):
    return F.concat(F.lit("BUS_"), F.element_at(F.split(F.col(block_column), "_"), -1))


def scheduled_trajectory(rows: DataFrame, order: Sequence[str] = ("timestamp_utc",),
                         keys: Sequence[str] = ("trip_id", "service_date"),
                         blocks: OrderBlocks | None = None) -> DataFrame:
    """Next arrival, segment seconds, scheduled speed, vehicle and fixed flags per scheduled stop."""
    ahead = Ordered(rows, list(keys), list(order), blocks).lead("timestamp_utc", "next_stop_arrival_utc").frame()
    seconds = seconds_between(F.col("next_stop_arrival_utc"), F.col("timestamp_utc"))
    timed = ahead.withColumn("segment_time_sec", seconds)
    raw_speed = F.try_divide(F.col("segment_distance_km"), F.col("segment_time_sec") / 3600.0)
    speed = F.when(F.col("segment_time_sec") > 0, clip(raw_speed, *SPEED_BOUNDS_KMH))
    return timed.withColumns({
        "current_speed_kmh": F.coalesce(speed, F.lit(DEFAULT_SPEED_KMH)),
        "vehicle_id": vehicle_id("block_id"),
        "latitude": F.col("stop_lat"), "longitude": F.col("stop_lon"), "is_at_stop": F.lit(1),
    }).withColumn("is_congested", flag(F.col("current_speed_kmh") < CONGESTED_BELOW_KMH))


def hourly_weather_join(rows: DataFrame, weather: DataFrame | None, ts: str = "timestamp_utc",
                        columns: Sequence[str] = ("temperature_2m", "relative_humidity_2m", "precipitation", "rain",
                                                  "wind_speed_10m", "weather_code")) -> DataFrame:
    """Left join on the hour that contains the event; unmatched hours stay NULL.

    Without a weather table the columns are typed NULLs.
    """
    if weather is None:
        return rows.withColumns({c: F.lit(None).cast("double") for c in columns})
    hourly = weather.select(F.date_trunc("hour", F.col("time").cast("timestamp")).alias("_hour"), *columns)
    return rows.withColumn("_hour", F.date_trunc("hour", F.col(ts).cast("timestamp"))).join(
        hourly, "_hour", "left").drop("_hour")


def match_rate(rows: DataFrame, column: str = "temperature_2m") -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total_rows"), F.count(column).alias("matched_rows"),
                    (F.count(column) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("match_rate_pct"))


def union_common(left: DataFrame, right: DataFrame) -> DataFrame:
    """Stack two tables on the columns both have."""
    common = [c for c in left.columns if c in right.columns]
    return left.select(*common).unionByName(right.select(*common))


def overlap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows of one table reappear in another; 0 means disjoint."""
    shared = left.join(right.select(*keys).distinct(), list(keys), "left_semi")
    return shared.agg(F.count(F.lit(1)).alias("shared_rows")).withColumn(
        "is_disjoint", F.when(F.col("shared_rows") == 0, 1).otherwise(0).cast("long"))
