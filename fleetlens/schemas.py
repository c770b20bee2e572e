"""Declared schemas of the raw tables and the feature lists."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: str) -> T.StructType:
    kinds = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields.items()])


GTFS_ROUTES = _schema(route_id="string", route_short_name="string", route_long_name="string")
GTFS_STOPS = _schema(stop_id="string", stop_code="string", stop_name="string", stop_lat="double", stop_lon="double")
GTFS_TRIPS = _schema(route_id="string", service_id="string", trip_id="string", direction_id="int",
                     block_id="string", shape_id="string")
GTFS_STOP_TIMES = _schema(trip_id="string", arrival_time="string", departure_time="string",
                          stop_id="string", stop_sequence="int")
GTFS = {"routes": GTFS_ROUTES, "stops": GTFS_STOPS, "trips": GTFS_TRIPS, "stop_times": GTFS_STOP_TIMES}

ROUTE_STOPS = _schema(stop_id="string", route_id="int", direction="string", address="string",
                      latitude="double", longitude="double")
RUNNING_TIMES = _schema(trip_id="double", deviceid="double", direction="double", segment="double", date="string",
                        start_time="string", end_time="string", run_time_in_seconds="double", length="double")
DWELL_TIMES = _schema(trip_id="double", deviceid="double", direction="double", bus_stop="double", date="string",
                      arrival_time="string", departure_time="string", dwell_time_in_seconds="double")
TRIPS = _schema(trip_id="double", deviceid="double", date="string", start_terminal="string", end_terminal="string",
                direction="double", start_time="string", end_time="string", duration="string",
                duration_in_mins="double")
WEATHER_HOURLY = _schema(time="string", temperature_2m="double", relative_humidity_2m="double",
                         precipitation="double", rain="double", weather_code="int", surface_pressure="double",
                         wind_speed_10m="double")
WEATHER_PAYLOAD = ("struct<hourly:struct<time:array<string>,temperature_2m:array<double>,"
                   "relative_humidity_2m:array<double>,precipitation:array<double>,rain:array<double>,"
                   "weather_code:array<int>,wind_speed_10m:array<double>>>")

# fixed values: model inputs
CATEGORICAL_FEATURES = ["deviceid", "direction", "segment"]
NUMERICAL_FEATURES = [
    "hour", "minute", "day_of_week", "is_weekend", "is_peak_period",
    "sin_hour", "cos_hour", "sin_time_of_day", "cos_time_of_day",
    "segment_length_km", "segments_completed", "segments_remaining", "trip_progress_ratio",
    "previous_segment_run_time", "rolling_prev_segment_mean", "rolling_prev_segment_std",
    "cumulative_trip_time_sec", "historical_segment_time_mean", "segment_delay_ratio", "congestion_proxy",
    "temperature_2m", "relative_humidity_2m", "precipitation", "rain", "wind_speed_10m", "weather_code",
]
WEATHER_FEATURES = ["temperature_2m", "relative_humidity_2m", "precipitation", "rain", "wind_speed_10m", "weather_code"]
KINEMATIC_FEATURES = [
    "segment_delay_ratio", "previous_segment_run_time", "rolling_prev_segment_mean", "rolling_prev_segment_std",
    "cumulative_trip_time_sec", "historical_segment_time_mean", "congestion_proxy",
]
TARGET = "eta_to_next_stop_sec"
