"""Fleet tables derived from the given event and order tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.columns import clip, round_to
from fleetlens.operators import evaluation, features, splits, topology
from fleetlens.operators.drift_windows import indexed
from fleetlens.ordering import Ordered, OrderBlocks, order_blocks, small_like
from fleetlens.plans.registry import cte, half_up
from fleetlens.schemas import NUMERICAL_FEATURES, WEATHER_FEATURES
from fleetlens.session import materialize

TIME_ORDER = ["timestamp_utc", "event_id"]
LAT_BOX, LON_BOX, SPEED_BOX, DELAY_BOX = (53.05, 53.65), (-6.65, -6.0), (0.0, 100.0), (-900.0, 3600.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured run times: a user is a trip, an event is a segment passed."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id")
    return e.select(
        "event_id", user.cast("string").alias("trip_id"), F.concat(F.lit("D"), user % 40).alias("deviceid"),
        (user % 2 + 1).cast("int").alias("direction"), (F.col("event_id") % 15 + 1).cast("int").alias("segment"),
        F.col("ts").cast("timestamp").alias("timestamp_utc"), F.col("value").alias("run_time_in_seconds"),
        ((user % 50 + 1) / 10.0).alias("length"), "event_type")


cte("obs", """SELECT event_id, CAST(user_id AS VARCHAR) AS trip_id, 'D' || CAST(user_id % 40 AS VARCHAR) AS deviceid,
  CAST(user_id % 2 + 1 AS INTEGER) AS direction, CAST(event_id % 15 + 1 AS INTEGER) AS segment, ts AS timestamp_utc,
  value AS run_time_in_seconds, CAST(user_id % 50 + 1 AS DOUBLE) / 10.0::DOUBLE AS length, event_type FROM events""")


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather from the error events; hours without one are missing."""
    v, n = F.col("value"), F.count(F.lit(1))
    errors = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return errors.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("time")).agg(
        (F.avg(v) / 25.0 + 15.0).alias("temperature_2m"),
        F.least(F.max(v) / 10.0 + 60.0, F.lit(100.0)).alias("relative_humidity_2m"),
        (F.max(v) / 100.0).alias("precipitation"), (F.min(v) / 100.0).alias("rain"),
        ((F.max(v) - F.min(v)) / 10.0).alias("wind_speed_10m"),
        F.when(n % 4 == 0, 0).when(n % 4 == 1, 2).when(n % 4 == 2, 61).otherwise(95).cast("double").alias("weather_code"))


cte("weather", """SELECT date_trunc('hour', ts) AS time, avg(value) / 25.0::DOUBLE + 15.0::DOUBLE AS temperature_2m,
  least(max(value) / 10.0::DOUBLE + 60.0::DOUBLE, 100.0::DOUBLE) AS relative_humidity_2m,
  max(value) / 100.0::DOUBLE AS precipitation, min(value) / 100.0::DOUBLE AS rain,
  (max(value) - min(value)) / 10.0::DOUBLE AS wind_speed_10m,
  CAST(CASE count(*) % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 61 ELSE 95 END AS DOUBLE) AS weather_code
  FROM events WHERE event_type = 'error' GROUP BY 1""")


def time_blocks(spark: SparkSession, sf_dir: str) -> OrderBlocks:
    """Cut points of the event time, read from the one column they need, and whether every trip fits a block."""
    e = table(spark, sf_dir, "events").select(F.col("ts").alias("timestamp_utc"), F.col("user_id").alias("trip_id"))
    return order_blocks(e.select("timestamp_utc"), "timestamp_utc").settle(e, ["trip_id"])


def fits(spark: SparkSession, sf_dir: str, *columns: str) -> dict[str, OrderBlocks] | None:
    """Block choice for other columns of frames derived row by row from the events."""
    return small_like(time_blocks(spark, sf_dir), *columns)


def with_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.hourly_weather_join(observations(spark, sf_dir), weather(spark, sf_dir))


cte("joined", """SELECT o.*, w.temperature_2m, w.relative_humidity_2m, w.precipitation, w.rain, w.wind_speed_10m, w.weather_code
  FROM obs o LEFT JOIN weather w ON date_trunc('hour', o.timestamp_utc) = w.time""", "obs", "weather")


def feature_table(spark: SparkSession, sf_dir: str, blocks: OrderBlocks | None = None) -> DataFrame:
    """The 29 model inputs of every observation."""
    rows = with_weather(spark, sf_dir)
    return features.run_time_features(rows, TIME_ORDER, blocks or time_blocks(spark, sf_dir), impute_from=rows)


cte("medians", "SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in WEATHER_FEATURES) + " FROM joined", "joined")
cte("hist", "SELECT direction, segment, avg(run_time_in_seconds) AS h FROM obs GROUP BY ALL", "obs")
cte("placed", """SELECT j.*, h.h AS historical_segment_time_mean,
  row_number() OVER w AS rn, count(*) OVER (PARTITION BY trip_id) AS total, lag(run_time_in_seconds) OVER w AS previous,
  hour(timestamp_utc) * 60 + minute(timestamp_utc) AS mod
  FROM joined j JOIN hist h USING (direction, segment)
  WINDOW w AS (PARTITION BY trip_id ORDER BY timestamp_utc, event_id)""", "joined", "hist")
cte("filled", "SELECT *, coalesce(previous, historical_segment_time_mean) AS previous_segment_run_time FROM placed", "placed")
cte("rolled", """SELECT *, avg(previous_segment_run_time) OVER t AS rolling_prev_segment_mean,
  coalesce(stddev_samp(previous_segment_run_time) OVER t, 0) AS rolling_prev_segment_std,
  greatest(sum(previous_segment_run_time) OVER (PARTITION BY trip_id ORDER BY timestamp_utc, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - previous_segment_run_time, 0) AS cumulative_trip_time_sec,
  least(greatest(previous_segment_run_time / CASE WHEN historical_segment_time_mean = 0 THEN 1 ELSE historical_segment_time_mean END,
    0.2::DOUBLE), 5.0::DOUBLE) AS segment_delay_ratio
  FROM filled WINDOW t AS (PARTITION BY trip_id ORDER BY timestamp_utc, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "filled")
cte("feats", """SELECT event_id, trip_id, deviceid, direction, segment, timestamp_utc, run_time_in_seconds, event_type,
  hour(timestamp_utc) AS hour, minute(timestamp_utc) AS minute, isodow(timestamp_utc) - 1 AS day_of_week,
  CASE WHEN isodow(timestamp_utc) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN mod BETWEEN 420 AND 540 OR mod BETWEEN 990 AND 1110 THEN 1 ELSE 0 END AS is_peak_period,
  sin(2 * pi() * hour(timestamp_utc) / 24) AS sin_hour, cos(2 * pi() * hour(timestamp_utc) / 24) AS cos_hour,
  sin(2 * pi() * mod / 1440) AS sin_time_of_day, cos(2 * pi() * mod / 1440) AS cos_time_of_day,
  length AS segment_length_km, rn - 1 AS segments_completed, total - rn AS segments_remaining,
  least(greatest((rn - 1) / total, 0), 1) AS trip_progress_ratio, previous_segment_run_time, rolling_prev_segment_mean,
  rolling_prev_segment_std, cumulative_trip_time_sec, historical_segment_time_mean, segment_delay_ratio,
  CASE WHEN segment_delay_ratio > 1.25 THEN 1 ELSE 0 END AS congestion_proxy, """
    + ", ".join(f"coalesce(r.{c}, m.{c}, 0) AS {c}" for c in WEATHER_FEATURES) + " FROM rolled r, medians m", "rolled", "medians")


def _prediction(share: float) -> Column:
    blend = F.lit(share) * F.col("rolling_prev_segment_mean") + F.lit(1.0 - share) * F.col("historical_segment_time_mean")
    return round_to(clip(blend, 3.0, 3600.0), 2)


def _prediction_sql(share: float) -> str:
    blend = (f"least(greatest({share}::DOUBLE * rolling_prev_segment_mean + {1.0 - share}::DOUBLE * "
             "historical_segment_time_mean, 3.0::DOUBLE), 3600.0::DOUBLE)")
    return half_up(blend)


def scored(spark: SparkSession, sf_dir: str, blocks: OrderBlocks | None = None) -> DataFrame:
    """Features with the outcome, a champion and a candidate prediction and their errors.

    Computed features are cut to 9 digits, so that rounding rules further on start
    from the same numbers in both engines.
    """
    table_ = feature_table(spark, sf_dir, blocks)
    rows = table_.withColumns({c: F.round(c, 9) for c in COMPUTED}).withColumns({
        "actual": F.col("run_time_in_seconds"), "predicted": _prediction(0.75), "candidate": _prediction(0.5)})
    return evaluation.with_errors(rows, "actual", "predicted")


COMPUTED = ["sin_hour", "cos_hour", "sin_time_of_day", "cos_time_of_day", "trip_progress_ratio", "previous_segment_run_time",
            "rolling_prev_segment_mean", "rolling_prev_segment_std", "cumulative_trip_time_sec",
            "historical_segment_time_mean", "segment_delay_ratio", *WEATHER_FEATURES]
cte("feats9", "SELECT * REPLACE (" + ", ".join(f"round({c}, 9) AS {c}" for c in COMPUTED) + ") FROM feats", "feats")
cte("preds", f"""SELECT *, run_time_in_seconds AS actual, {_prediction_sql(0.75)} AS predicted,
  {_prediction_sql(0.5)} AS candidate FROM feats9""", "feats9")
cte("scored", """SELECT *, actual - predicted AS signed_error_sec, abs(actual - predicted) AS absolute_error_sec,
  row_number() OVER (ORDER BY timestamp_utc, event_id) - 1 AS idx, count(*) OVER () AS n FROM preds""", "preds")


def scored_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows with their stream position."""
    blocks = time_blocks(spark, sf_dir)
    return indexed(scored(spark, sf_dir, blocks), TIME_ORDER, blocks)


def stored_scored(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the scored rows, written once: cut points, block summaries and quantiles read rows again, and the features behind them are expensive."""
    return materialize(scored(spark, sf_dir, time_blocks(spark, sf_dir)).select(*columns), "scored")


def stored_stream(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the scored rows with their stream position, written once."""
    rows = stored_scored(spark, sf_dir, *dict.fromkeys([*TIME_ORDER, *columns]))
    return materialize(indexed(rows, TIME_ORDER, time_blocks(spark, sf_dir)), "stream")


def raw_run_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-time records with missing ids, bad dates, impossible values and exact copies."""
    e, i, ts = table(spark, sf_dir, "events"), F.col("event_id"), F.col("ts")
    base = e.select(
        i, F.when(i % 37 != 0, F.col("user_id")).cast("double").alias("trip_id"),
        (F.col("user_id") % 40).cast("double").alias("deviceid"), (F.col("user_id") % 2 + 1).cast("double").alias("direction"),
        (i % 15 + 1).cast("double").alias("segment"),
        F.when(i % 41 == 0, "invalid_date").otherwise(F.date_format(ts, "yyyy-MM-dd")).alias("date"),
        F.date_format(ts, "HH:mm:ss").alias("start_time"),
        F.when(i % 29 == 0, -10.0).when(i % 31 != 0, F.col("value") * 3.0).alias("run_time_in_seconds"),
        ((F.col("user_id") % 50 + 1) / 10.0).alias("length"))
    copies = F.explode(F.when(i % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return base.select("*", copies.alias("_copy")).drop("_copy", "event_id")


cte("raw_run", """SELECT CASE WHEN event_id % 37 <> 0 THEN CAST(user_id AS DOUBLE) END AS trip_id,
  CAST(user_id % 40 AS DOUBLE) AS deviceid, CAST(user_id % 2 + 1 AS DOUBLE) AS direction,
  CAST(event_id % 15 + 1 AS DOUBLE) AS segment,
  CASE WHEN event_id % 41 = 0 THEN 'invalid_date' ELSE strftime(ts, '%Y-%m-%d') END AS date,
  strftime(ts, '%H:%M:%S') AS start_time,
  CASE WHEN event_id % 29 = 0 THEN -10.0::DOUBLE WHEN event_id % 31 <> 0 THEN value * 3.0::DOUBLE END AS run_time_in_seconds,
  CAST(user_id % 50 + 1 AS DOUBLE) / 10.0::DOUBLE AS length
  FROM events, (VALUES (1), (2)) AS c(copy) WHERE copy = 1 OR event_id % 50 = 0""")
cte("clean_run", """SELECT DISTINCT CAST(CAST(trip_id AS BIGINT) AS VARCHAR) AS trip_id,
  CAST(CAST(deviceid AS BIGINT) AS VARCHAR) AS deviceid, CAST(direction AS INTEGER) AS direction,
  CAST(segment AS INTEGER) AS segment, try_cast(date || ' ' || start_time AS TIMESTAMP) AS timestamp_utc,
  run_time_in_seconds, length, '654' AS route_id FROM raw_run
  WHERE trip_id IS NOT NULL AND run_time_in_seconds BETWEEN 3 AND 3600
    AND try_cast(date || ' ' || start_time AS TIMESTAMP) IS NOT NULL""", "raw_run")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicle positions with rows outside the area, too fast, or without a time, trip, route or stop."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        i, F.when(i % 43 != 0, F.col("ts").cast("timestamp")).alias("timestamp_utc"),
        F.when(i % 47 != 0, F.lit(53.0) + (i % 70) / 100.0).alias("latitude"),
        (F.lit(-6.7) + (i % 75) / 100.0).alias("longitude"), F.col("value").alias("current_speed_kmh"),
        (F.col("value") * 20.0 - 1000.0).alias("delay"), (i % 3).cast("int").alias("at_stop"),
        (i % 2).cast("int").alias("congestion"),
        F.when(i % 53 != 0, F.col("event_type")).alias("route_id"),
        F.when(i % 59 != 0, F.col("user_id").cast("string")).alias("trip_id"),
        F.when(i % 61 != 0, (i % 200).cast("string")).alias("stop_id"))


cte("positions", """SELECT event_id, CASE WHEN event_id % 43 <> 0 THEN ts END AS timestamp_utc,
  CASE WHEN event_id % 47 <> 0 THEN 53.0::DOUBLE + CAST(event_id % 70 AS DOUBLE) / 100.0::DOUBLE END AS latitude,
  (-6.7)::DOUBLE + CAST(event_id % 75 AS DOUBLE) / 100.0::DOUBLE AS longitude, value AS current_speed_kmh,
  value * 20.0::DOUBLE - 1000.0::DOUBLE AS delay, CAST(event_id % 3 AS INTEGER) AS at_stop,
  CAST(event_id % 2 AS INTEGER) AS congestion, CASE WHEN event_id % 53 <> 0 THEN event_type END AS route_id,
  CASE WHEN event_id % 59 <> 0 THEN CAST(user_id AS VARCHAR) END AS trip_id,
  CASE WHEN event_id % 61 <> 0 THEN CAST(event_id % 200 AS VARCHAR) END AS stop_id FROM events""")


def gtfs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A schedule: customers are routes, orders trips, lineitems stop times, parts stops."""
    c, o, li, p = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "part"))
    key = F.col("p_partkey")
    return {
        "routes": c.select(F.col("c_custkey").cast("string").alias("route_id"), F.col("c_mktsegment").alias("route_short_name")),
        "trips": o.select(F.col("o_custkey").cast("string").alias("route_id"), F.col("o_orderkey").cast("string").alias("trip_id"),
                          F.concat(F.lit("B_"), F.col("o_orderkey") % 97).alias("block_id")),
        "stop_times": li.select(
            F.col("l_orderkey").cast("string").alias("trip_id"), F.col("l_partkey").cast("string").alias("stop_id"),
            F.col("l_linenumber").alias("stop_sequence"), "l_partkey", "l_suppkey", "l_extendedprice",
            F.format_string("%02d:%02d:%02d", (F.col("l_linenumber") * 3 + 5).cast("long"), F.col("l_partkey") % 60,
                            F.col("l_suppkey") % 60).alias("arrival_time")),
        "stops": p.select(key.cast("string").alias("stop_id"), (F.lit(53.15) + (key % 41) / 100.0).alias("stop_lat"),
                          (F.lit(-6.55) + (key % 51) / 100.0).alias("stop_lon")),
    }


STOP_ORDER = ["stop_sequence", "l_partkey", "l_suppkey", "l_extendedprice"]
cte("routes", "SELECT CAST(c_custkey AS VARCHAR) AS route_id, c_mktsegment AS route_short_name FROM customer")
cte("trips", """SELECT CAST(o_custkey AS VARCHAR) AS route_id, CAST(o_orderkey AS VARCHAR) AS trip_id,
  'B_' || CAST(o_orderkey % 97 AS VARCHAR) AS block_id FROM orders""")
cte("stop_times", """SELECT CAST(l_orderkey AS VARCHAR) AS trip_id, CAST(l_partkey AS VARCHAR) AS stop_id,
  l_linenumber AS stop_sequence, l_partkey, l_suppkey, l_extendedprice,
  printf('%02d:%02d:%02d', l_linenumber * 3 + 5, l_partkey % 60, l_suppkey % 60) AS arrival_time FROM lineitem""")
cte("stops", """SELECT CAST(p_partkey AS VARCHAR) AS stop_id, 53.15::DOUBLE + CAST(p_partkey % 41 AS DOUBLE) / 100.0::DOUBLE AS stop_lat,
  (-6.55)::DOUBLE + CAST(p_partkey % 51 AS DOUBLE) / 100.0::DOUBLE AS stop_lon FROM part""")


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop times with their trip, route and position."""
    t = gtfs(spark, sf_dir)
    trips = topology.trips_with_routes(t["trips"], t["routes"])
    return topology.with_stop_positions(topology.with_stop_times(trips, t["stop_times"]), t["stops"])


cte("schedule", """SELECT s.*, t.route_id, t.block_id, r.route_short_name, p.stop_lat, p.stop_lon FROM stop_times s
  JOIN trips t USING (trip_id) JOIN routes r USING (route_id) JOIN stops p USING (stop_id)""",
    "stop_times", "trips", "routes", "stops")


def stop_blocks(spark: SparkSession, sf_dir: str) -> OrderBlocks:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("stop_sequence"), F.col("l_orderkey").alias("trip_id"))
    return order_blocks(li.select("stop_sequence"), "stop_sequence").settle(li, ["trip_id"])


def sequences(spark: SparkSession, sf_dir: str, blocks: OrderBlocks | None = None) -> DataFrame:
    return topology.stop_sequences(schedule(spark, sf_dir), STOP_ORDER, blocks=blocks or stop_blocks(spark, sf_dir))


HAVERSINE_SQL = """2 * 6371.0::DOUBLE * asin(sqrt(least(greatest(
    pow(sin((radians({b_lat}) - radians({a_lat})) / 2), 2) + cos(radians({a_lat})) * cos(radians({b_lat})) *
    pow(sin((radians({b_lon}) - radians({a_lon})) / 2), 2), 0), 1)))"""
_segment = HAVERSINE_SQL.format(a_lat="stop_lat", a_lon="stop_lon", b_lat="next_stop_lat", b_lon="next_stop_lon")
cte("ahead", """SELECT *, lead(stop_id) OVER w AS next_stop_id, lead(stop_lat) OVER w AS next_stop_lat,
  lead(stop_lon) OVER w AS next_stop_lon, max(stop_sequence) OVER (PARTITION BY trip_id) - stop_sequence AS stops_remaining
  FROM schedule WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence, l_partkey, l_suppkey, l_extendedprice)""", "schedule")
cte("measured", f"SELECT *, coalesce({_segment}, 0) AS segment_distance_km FROM ahead", "ahead")
cte("sequences", """SELECT *, sum(segment_distance_km) OVER (PARTITION BY trip_id
  ORDER BY stop_sequence, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  AS cumulative_distance_km FROM measured""", "measured")


def split_rows(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    return splits.chronological_split(rows if rows is not None else observations(spark, sf_dir), TIME_ORDER,
                                      blocks=time_blocks(spark, sf_dir))


cte("split_obs", """SELECT *, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train'
  WHEN i < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'validation' ELSE 'stream' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY timestamp_utc, event_id) - 1 AS i, count(*) OVER () AS n FROM obs)""", "obs")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model transition log: every user is a model walking the lifecycle, errors reject it."""
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("M"), F.col("user_id")).alias("model_id"), F.col("ts").alias("ts"), "event_id", "event_type")
    placed = Ordered(e, ["model_id"], ["ts", "event_id"]).row_number("rn").frame()
    path = F.array(*[F.lit(s) for s in LIFECYCLE_PATH])
    status = F.when(F.col("event_type") == "error", "REJECTED").otherwise(
        F.get(path, ((F.col("rn") - 1) % len(LIFECYCLE_PATH)).cast("int")))
    return placed.select("model_id", "ts", "event_id", status.alias("to_status"))


LIFECYCLE_PATH = ["CANDIDATE", "VALIDATED", "SHADOW", "CANARY_10", "CANARY_50", "PROMOTION_CANDIDATE", "PRODUCTION",
                  "ARCHIVED"]
cte("log", f"""SELECT model_id, ts, event_id, CASE WHEN event_type = 'error' THEN 'REJECTED'
  ELSE {LIFECYCLE_PATH!r}[CAST((rn - 1) % {len(LIFECYCLE_PATH)} AS INTEGER) + 1] END AS to_status
  FROM (SELECT 'M' || CAST(user_id AS VARCHAR) AS model_id, ts, event_id, event_type,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)""")


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model descends from the one before it; one in five has no recorded parent."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(F.concat(F.lit("M"), F.col("user_id")).alias("model_id"),
                        F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("M"), F.col("user_id") - 1)).alias("parent_model_id"))


cte("parents", """SELECT DISTINCT 'M' || CAST(user_id AS VARCHAR) AS model_id,
  CASE WHEN user_id % 5 <> 0 THEN 'M' || CAST(user_id - 1 AS VARCHAR) END AS parent_model_id FROM events""")

DRIFT_FEATURES = list(NUMERICAL_FEATURES)
