"""Queries over sources, quality checks, cleaning, joins, labels, features and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import schemas
from fleetlens.operators import cleaning, features, labels, quality, splits, topology
from fleetlens.plans import testbed as T
from fleetlens.plans.registry import clean_time, query, rounded, s6
from fleetlens.session import scratch_path
from fleetlens.sources import readers, writers


def _gps_rules():
    return cleaning.position_rules(T.LAT_BOX, T.LON_BOX, T.SPEED_BOX)


# --- sources and sinks ------------------------------------------------------------------

@query("a01_gtfs_csv_scan", f"""SELECT r.route_short_name, count(*) AS trips, count(DISTINCT t.block_id) AS blocks
  FROM trips t JOIN routes r USING (route_id) GROUP BY 1""", ("trips", "routes"))
def gtfs_csv_scan(spark, d):
    folder = scratch_path(spark, "gtfs")
    tables = T.gtfs(spark, d)
    for name, schema in schemas.GTFS.items():
        have = tables[name].columns
        full = tables[name].select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                                     for f in schema.fields])
        full.write.option("header", True).csv(f"{folder}/{name}.txt")
    read = readers.read_gtfs(spark, folder)
    trips = topology.trips_with_routes(read["trips"].select("route_id", "block_id"), read["routes"])
    return trips.groupBy("route_short_name").agg(F.count(F.lit(1)).alias("trips"), F.count_distinct("block_id").alias("blocks"))


@query("a02_csv_scan", f"""SELECT count(*) AS total_rows, count(trip_id) AS with_trip, count(run_time_in_seconds) AS with_time,
  {s6('avg(run_time_in_seconds)')} AS mean_time FROM raw_run""", ("raw_run",))
def csv_scan(spark, d):
    path = scratch_path(spark, "running-times")
    raw = T.raw_run_times(spark, d).withColumn("end_time", F.col("start_time"))
    raw.select(*schemas.RUNNING_TIMES.names).write.option("header", True).csv(path)
    out = readers.read_running_times(spark, path).agg(
        F.count(F.lit(1)).alias("total_rows"), F.count("trip_id").alias("with_trip"),
        F.count("run_time_in_seconds").alias("with_time"), F.avg("run_time_in_seconds").alias("mean_time"))
    return rounded(out, "mean_time")


@query("a03_scan_profile", """SELECT count(*) AS total_rows, CAST(0 AS BIGINT) AS null_cells,
  count(DISTINCT l_orderkey) AS distinct_l_orderkey, count(DISTINCT l_partkey) AS distinct_l_partkey FROM lineitem""")
def scan_profile(spark, d):
    rows = T.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return quality.scan_profile(rows, ["l_orderkey", "l_partkey"])


@query("a04_parquet_scan", f"""SELECT l_returnflag, count(*) AS records, {s6('avg(l_quantity)')} AS mean_quantity
  FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1""")
def parquet_scan(spark, d):
    rows = readers.read_parquet(spark, f"{d}/lineitem.parquet").filter(
        F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return rounded(rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("records"),
                                                    F.avg("l_quantity").alias("mean_quantity")), "mean_quantity")


@query("a05_partitioned_write", "SELECT split, count(*) AS records FROM split_obs WHERE split = 'validation' GROUP BY 1",
       ("split_obs",))
def partitioned_write(spark, d):
    path = scratch_path(spark, "splits")
    writers.write_table(T.split_rows(spark, d), path, partition_by="split")
    return spark.read.parquet(path).filter(F.col("split") == "validation").groupBy("split").agg(
        F.count(F.lit(1)).alias("records"))


@query("a06_event_log", "SELECT event_type, 2 * count(*) AS records FROM events GROUP BY 1")
def event_log(spark, d):
    path = scratch_path(spark, "event-log")
    rows = T.table(spark, d, "events").select("event_id", "event_type", "value")
    writers.append_events(rows, path)
    writers.append_events(rows, path)
    return spark.read.schema(rows.schema).json(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("records"))


@query("a07_report_document", "SELECT count(*) AS total_rows, count(*) - count(trip_id) AS missing_trips FROM raw_run", ("raw_run",))
def report_document(spark, d):
    path = scratch_path(spark, "report")
    raw = T.raw_run_times(spark, d)
    report = raw.agg(F.struct(F.count(F.lit(1)).alias("total_rows"),
                              F.count_if(F.col("trip_id").isNull()).alias("missing_trips")).alias("summary"))
    writers.write_report(report, path)
    return spark.read.schema(report.schema).json(path).select("summary.*")


@query("a08_weather_payload", f"""SELECT strftime(time, '%Y-%m-%dT%H:%M') AS time, {s6('temperature_2m')} AS temperature_2m,
  {s6('rain')} AS rain, CAST(weather_code AS BIGINT) AS weather_code FROM weather""", ("weather",))
def weather_payload(spark, d):
    names = ["time", "temperature_2m", "relative_humidity_2m", "precipitation", "rain", "weather_code", "wind_speed_10m"]
    hourly = T.weather(spark, d).withColumn("day", F.to_date("time")).withColumn(
        "time", F.date_format("time", "yyyy-MM-dd'T'HH:mm")).withColumn("weather_code", F.col("weather_code").cast("int"))
    # a day holds at most 24 hourly rows
    days = hourly.groupBy("day").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("rows"))
    payload = F.to_json(F.struct(F.struct(*[F.col("rows")[n].alias(n) for n in names]).alias("hourly")))
    out = readers.weather_rows(days.select(payload.alias("payload")))
    return rounded(out.select("time", "temperature_2m", "rain", F.col("weather_code").cast("long")), "temperature_2m", "rain")


@query("a10_replay_source", """SELECT event_id, timestamp_utc, segment, run_time_in_seconds FROM obs
  WHERE direction = 1 AND deviceid = 'D8'""", ("obs",))
def replay_source(spark, d):
    rows = readers.replay(T.observations(spark, d), {"direction": 1, "deviceid": "D8"}, tuple(T.TIME_ORDER))
    return rows.select("event_id", clean_time("timestamp_utc").alias("timestamp_utc"), "segment", "run_time_in_seconds")


@query("a11_file_fingerprints")
def file_fingerprints(spark, d):
    return readers.fingerprints(spark, d, "*.parquet").select("file_name", "size_bytes", "sha256")


def _digest_sql(columns: list[str]) -> str:
    parts = " || '|' || ".join(f"coalesce('v' || CAST({c} AS VARCHAR), 'n')" for c in columns)
    return f"CAST(sum(CAST('0x' || substr(sha256({parts}), 1, 15) AS HUGEINT)) AS VARCHAR)"


_EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query("a12_table_hash", f"SELECT count(*) AS row_count, {_digest_sql(_EVENT_COLUMNS)} AS content_hash FROM events")
def table_hash(spark, d):
    return splits.table_hash(T.table(spark, d, "events"), _EVENT_COLUMNS)


@query("a13_source_unchanged", "SELECT CAST(0 AS BIGINT) AS changed_files")
def source_unchanged(spark, d):
    """Fingerprints are written first and compared with those of the files as they then are."""
    from fleetlens.session import materialize
    before = materialize(readers.fingerprints(spark, d, "*.parquet"), "fingerprints")
    return readers.unchanged(before, readers.fingerprints(spark, d, "*.parquet")).agg(F.count(F.lit(1)).alias("changed_files"))


# --- profiling and validation -----------------------------------------------------------

RAW_COLUMNS = ["trip_id", "deviceid", "direction", "segment", "date", "start_time", "run_time_in_seconds", "length"]


@query("b01_null_report", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, "
    f"{s6(f'(count(*) - count({c})) * 100.0 / count(*)')} AS missing_pct FROM raw_run" for c in RAW_COLUMNS), ("raw_run",))
def null_report(spark, d):
    return rounded(quality.null_report(T.raw_run_times(spark, d)), "missing_pct")


@query("b02_duplicates", f"""SELECT CAST(sum(c) AS BIGINT) AS total_rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_count,
  {s6('sum(c - 1) * 100.0 / sum(c)')} AS duplicate_pct FROM (SELECT count(*) AS c FROM raw_run GROUP BY ALL, trip_id, deviceid,
  direction, segment, date, start_time, run_time_in_seconds, length)""".replace("GROUP BY ALL, ", "GROUP BY "), ("raw_run",))
def duplicates(spark, d):
    return rounded(quality.duplicate_report(T.raw_run_times(spark, d)), "duplicate_pct")


COORDS_SQL = (f"(latitude < {T.LAT_BOX[0]} OR latitude > {T.LAT_BOX[1]} OR longitude < {T.LON_BOX[0]} "
              f"OR longitude > {T.LON_BOX[1]})")
SPEED_SQL = f"(current_speed_kmh < {T.SPEED_BOX[0]} OR current_speed_kmh > {T.SPEED_BOX[1]})"
DELAY_SQL = f"(delay < {T.DELAY_BOX[0]} OR delay > {T.DELAY_BOX[1]})"


def _coords():
    return quality.coordinate_violations("latitude", "longitude", T.LAT_BOX, T.LON_BOX)


def _speed():
    return quality.outside("current_speed_kmh", *T.SPEED_BOX)


@query("b03_coordinate_bounds", f"""SELECT count(*) FILTER (WHERE {COORDS_SQL}) AS out_of_bounds,
  {s6(f'count(*) FILTER (WHERE {COORDS_SQL}) * 100.0 / count(*)')} AS out_of_bounds_pct FROM positions""", ("positions",))
def coordinate_bounds(spark, d):
    return rounded(quality.bounds_report(T.positions(spark, d), _coords(), "out_of_bounds"), "out_of_bounds_pct")


@query("b04_impossible_speed", f"""SELECT count(*) FILTER (WHERE {SPEED_SQL}) AS impossible_speed,
  {s6(f'count(*) FILTER (WHERE {SPEED_SQL}) * 100.0 / count(*)')} AS impossible_speed_pct FROM positions""", ("positions",))
def impossible_speed(spark, d):
    return rounded(quality.bounds_report(T.positions(spark, d), _speed(), "impossible_speed"), "impossible_speed_pct")


@query("b05_timestamp_report", """SELECT 'timestamp_utc' AS column_name, CAST(0 AS BIGINT) AS is_numeric,
  min(timestamp_utc) AS min_timestamp, max(timestamp_utc) AS max_timestamp FROM positions""", ("positions",))
def timestamp_report(spark, d):
    out = quality.timestamp_report(T.positions(spark, d), "timestamp_utc")
    return out.withColumns({c: clean_time(c) for c in ("min_timestamp", "max_timestamp")})


@query("b06_delay_report", f"""SELECT count(*) FILTER (WHERE {DELAY_SQL}) AS invalid_delay_count,
  {s6('avg(delay)')} AS mean_delay_sec, {s6('stddev_samp(delay)')} AS std_delay_sec FROM positions""", ("positions",))
def delay_report(spark, d):
    return rounded(quality.delay_report(T.positions(spark, d), "delay", *T.DELAY_BOX), "mean_delay_sec", "std_delay_sec")


@query("b07_binary_flags", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} NOT IN (0, 1)) AS invalid_count, "
    f"CAST(count(*) FILTER (WHERE {c} NOT IN (0, 1)) = 0 AS BIGINT) AS is_binary FROM positions"
    for c in ("at_stop", "congestion")), ("positions",))
def binary_flags(spark, d):
    return quality.binary_flags_report(T.positions(spark, d), ["at_stop", "congestion"])


@query("b08_validation_verdict", f"""SELECT *, CAST(total_rows > 0 AND out_of_bounds_coords_count + impossible_speed_count
  + invalid_delay_count <= total_rows * 0.1 AS BIGINT) AS is_valid FROM (SELECT count(*) AS total_rows,
  count(*) FILTER (WHERE {COORDS_SQL}) AS out_of_bounds_coords_count, count(*) FILTER (WHERE {SPEED_SQL}) AS impossible_speed_count,
  count(*) FILTER (WHERE {DELAY_SQL}) AS invalid_delay_count FROM positions)""", ("positions",))
def validation_verdict(spark, d):
    return quality.validation_verdict(T.positions(spark, d), _coords(), _speed(), quality.outside("delay", *T.DELAY_BOX))


PROFILED = ["run_time_in_seconds", "length", "segment"]


@query("b10_numeric_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, {s6(f'avg({c})')} AS mean, {s6(f'min({c})')} AS min, "
    f"{s6(f'max({c})')} AS max, {s6(f'stddev_samp({c})')} AS std, {s6(f'median({c})')} AS median FROM raw_run"
    for c in PROFILED), ("raw_run",))
def numeric_summary(spark, d):
    out = quality.numeric_summary(T.raw_run_times(spark, d), PROFILED)
    return rounded(out, "mean", "min", "max", "std", "median")


@query("b11_distinct_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count FROM raw_run" for c in ("trip_id", "deviceid", "segment", "date")),
    ("raw_run",))
def distinct_counts(spark, d):
    return quality.distinct_counts(T.raw_run_times(spark, d), ["trip_id", "deviceid", "segment", "date"])


@query("b11_distinct_values", "SELECT DISTINCT segment FROM raw_run WHERE segment IS NOT NULL", ("raw_run",))
def distinct_values(spark, d):
    return quality.distinct_values(T.raw_run_times(spark, d), "segment")


@query("b12_extent", """SELECT min(timestamp_utc) AS min_timestamp_utc, max(timestamp_utc) AS max_timestamp_utc,
  min(latitude) AS min_latitude, max(latitude) AS max_latitude, min(longitude) AS min_longitude, max(longitude) AS max_longitude
  FROM positions""", ("positions",))
def extent(spark, d):
    out = quality.extent(T.positions(spark, d), ["timestamp_utc", "latitude", "longitude"])
    return out.withColumns({c: clean_time(c) for c in ("min_timestamp_utc", "max_timestamp_utc")})


BASELINE_COLUMNS = ["run_time_in_seconds", "segment_length_km", "previous_segment_run_time", "temperature_2m", "precipitation"]
_QUANTILES = ", ".join(f"{s6(f'quantile_cont(v, {p})')} AS {n}" for n, p in quality.QUANTILE_NAMES.items())


@query("b13_baseline_distributions", f"""SELECT column_name, {s6('avg(v)')} AS mean, {s6('stddev_samp(v)')} AS std,
  {s6('max(v)')} AS max, {_QUANTILES} FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS v FROM feats" for c in BASELINE_COLUMNS) + ") GROUP BY 1", ("feats",))
def baseline_distributions(spark, d):
    out = quality.distribution_table(T.feature_table(spark, d), BASELINE_COLUMNS)
    return rounded(out, "mean", "std", "max", *quality.QUANTILE_NAMES)


@query("b14_quality_dashboard", f"""SELECT 'rows_raw' AS metric, CAST(count(*) AS DOUBLE) AS value FROM raw_run
  UNION ALL SELECT 'rows_clean', count(*) FROM clean_run
  UNION ALL SELECT 'unique_trips', count(DISTINCT trip_id) FROM cw UNION ALL SELECT 'unique_devices', count(DISTINCT deviceid) FROM cw
  UNION ALL SELECT 'first_micros', epoch_us(min(timestamp_utc)) FROM cw UNION ALL SELECT 'last_micros', epoch_us(max(timestamp_utc)) FROM cw
  UNION ALL SELECT 'weather_match_pct', {s6('count(temperature_2m) * 100.0 / count(*)')} FROM cw""".replace(
    " cw", " (SELECT c.*, w.temperature_2m FROM clean_run c LEFT JOIN weather w ON date_trunc('hour', c.timestamp_utc) = w.time)"),
    ("clean_run", "weather"))
def quality_dashboard(spark, d):
    raw = T.raw_run_times(spark, d)
    clean = cleaning.clean_run_times(raw)
    matched = topology.hourly_weather_join(clean, T.weather(spark, d))
    out = quality.quality_dashboard({"raw": raw, "clean": clean}, matched, "trip_id", "deviceid", "timestamp_utc", "temperature_2m")
    return rounded(out, "value")


@query("b15_quarantine", f"""SELECT event_id, concat_ws(',', CASE WHEN {COORDS_SQL} THEN 'coordinates' END,
  CASE WHEN {SPEED_SQL} THEN 'speed' END, CASE WHEN {DELAY_SQL} THEN 'delay' END) AS broken_rules FROM positions
  WHERE {COORDS_SQL} OR {SPEED_SQL} OR {DELAY_SQL}""", ("positions",))
def quarantine(spark, d):
    rules = {"coordinates": _coords(), "speed": _speed(), "delay": quality.outside("delay", *T.DELAY_BOX)}
    return quality.quarantine(T.positions(spark, d), rules).select("event_id", "broken_rules")


# --- cleaning ---------------------------------------------------------------------------

def _by_segment(df: DataFrame, value: str = "run_time_in_seconds") -> DataFrame:
    out = df.groupBy("segment").agg(F.count(F.lit(1)).alias("records"), F.avg(value).alias("mean_value"))
    return rounded(out, "mean_value")


def _by_segment_sql(source: str, where: str = "true") -> str:
    return (f"SELECT segment, count(*) AS records, {s6('avg(run_time_in_seconds)')} AS mean_value FROM {source} "
            f"WHERE {where} GROUP BY 1")


@query("c01_drop_duplicates", _by_segment_sql("(SELECT DISTINCT * FROM raw_run)"), ("raw_run",))
def drop_duplicates(spark, d):
    return _by_segment(cleaning.drop_duplicates(T.raw_run_times(spark, d)))


def _kept(name: str, where: str, condition):
    @query(name, f"SELECT event_id FROM positions WHERE {where}", ("positions",))
    def run(spark, d):
        return condition(T.positions(spark, d)).select("event_id")
    return run


_kept("c02_require_timestamp", "timestamp_utc IS NOT NULL", lambda p: cleaning.require(p, ["timestamp_utc"]))
_kept("c03_bounding_box", f"latitude BETWEEN {T.LAT_BOX[0]} AND {T.LAT_BOX[1]} AND longitude BETWEEN {T.LON_BOX[0]} AND {T.LON_BOX[1]}",
      lambda p: cleaning.within_box(p, "latitude", "longitude", T.LAT_BOX, T.LON_BOX))
_kept("c04_speed_range", f"current_speed_kmh BETWEEN {T.SPEED_BOX[0]} AND {T.SPEED_BOX[1]}",
      lambda p: cleaning.within(p, "current_speed_kmh", *T.SPEED_BOX))
_kept("c05_require_route_trip", "route_id IS NOT NULL AND trip_id IS NOT NULL", lambda p: cleaning.require(p, ["route_id", "trip_id"]))
_kept("c06_require_stop", "stop_id IS NOT NULL", lambda p: cleaning.require(p, ["stop_id"]))


@query("c07_require_keys", _by_segment_sql("raw_run", "trip_id IS NOT NULL AND run_time_in_seconds IS NOT NULL"), ("raw_run",))
def require_keys(spark, d):
    return _by_segment(cleaning.require(T.raw_run_times(spark, d), cleaning.RUN_TIME_KEYS))


@query("c08_parse_times", """SELECT trip_id, segment, length, try_cast(date || ' ' || start_time AS TIMESTAMP) AS timestamp_utc
  FROM raw_run WHERE try_cast(date || ' ' || start_time AS TIMESTAMP) IS NOT NULL""", ("raw_run",))
def parse_times(spark, d):
    rows = cleaning.parse_times(T.raw_run_times(spark, d))
    return rows.select("trip_id", "segment", "length", clean_time("timestamp_utc").alias("timestamp_utc"))


@query("c09_run_time_bounds", _by_segment_sql("raw_run", "run_time_in_seconds BETWEEN 3 AND 3600"), ("raw_run",))
def run_time_bounds(spark, d):
    return _by_segment(cleaning.within(T.raw_run_times(spark, d), "run_time_in_seconds", *cleaning.RUN_TIME_BOUNDS))


@query("c10_normalize_ids", """SELECT trip_id, deviceid, direction, segment, route_id, timestamp_utc, run_time_in_seconds
  FROM clean_run""", ("clean_run",))
def normalize_ids(spark, d):
    rows = cleaning.clean_run_times(T.raw_run_times(spark, d))
    return rows.select("trip_id", "deviceid", "direction", "segment", "route_id", clean_time("timestamp_utc").alias("timestamp_utc"),
                       "run_time_in_seconds")


@query("c11_chronological_order", "SELECT trip_id, segment, timestamp_utc FROM clean_run", ("clean_run",))
def chronological_order(spark, d):
    rows = cleaning.chronological(cleaning.clean_run_times(T.raw_run_times(spark, d)), ["trip_id", "timestamp_utc", "segment"])
    return rows.select("trip_id", "segment", clean_time("timestamp_utc").alias("timestamp_utc"))


def _audit_sql(source: str, rules: list[tuple[str, str, str]]) -> str:
    """Step by step: distinct rows, then one filter after another."""
    parts = [f"SELECT 0 AS k, 'duplicate_removal' AS stage, 'Exact duplicate rows' AS reason, (SELECT count(*) FROM {source}) AS b, "
             "(SELECT count(*) FROM u) AS a"]
    passed = "true"
    for k, (stage, reason, where) in enumerate(rules, 1):
        before, passed = passed, f"{passed} AND ({where})"
        parts.append(f"SELECT {k}, '{stage}', '{reason}', (SELECT count(*) FROM u WHERE {before}), "
                     f"(SELECT count(*) FROM u WHERE {passed})")
    return (f"SELECT CAST(k AS BIGINT) AS stage_number, stage, reason, b AS records_before, b - a AS records_removed, "
            f"a AS records_remaining FROM ({' UNION ALL '.join(parts)})")


RUN_RULES_SQL = [
    ("missing_attributes_filter", "Missing key attributes", "trip_id IS NOT NULL AND run_time_in_seconds IS NOT NULL"),
    ("timestamp_parsing", "Malformed date or start_time strings", "try_cast(date || ' ' || start_time AS TIMESTAMP) IS NOT NULL"),
    ("run_time_bounds", "Run time outside bounds", "run_time_in_seconds BETWEEN 3 AND 3600")]
GPS_RULES_SQL = [
    ("timestamp_filter", "Missing timestamp", "timestamp_utc IS NOT NULL"),
    ("coordinate_filter", "Outside the area", f"latitude BETWEEN {T.LAT_BOX[0]} AND {T.LAT_BOX[1]} AND longitude BETWEEN {T.LON_BOX[0]} AND {T.LON_BOX[1]}"),
    ("speed_filter", "Impossible speed", f"current_speed_kmh BETWEEN {T.SPEED_BOX[0]} AND {T.SPEED_BOX[1]}"),
    ("route_trip_filter", "Missing route or trip", "route_id IS NOT NULL AND trip_id IS NOT NULL"),
    ("stop_filter", "Missing stop", "stop_id IS NOT NULL")]


@query("c12_cleaning_audit", "SELECT * FROM (WITH u AS (SELECT DISTINCT * FROM raw_run) " + _audit_sql("raw_run", RUN_RULES_SQL) + ")", ("raw_run",))
def cleaning_audit(spark, d):
    return cleaning.audit_trail(T.raw_run_times(spark, d), cleaning.run_time_rules())


@query("c12_position_audit", "SELECT * FROM (WITH u AS (SELECT DISTINCT * FROM positions) " + _audit_sql("positions", GPS_RULES_SQL) + ")", ("positions",))
def position_audit(spark, d):
    return cleaning.audit_trail(T.positions(spark, d), _gps_rules())


@query("c13_retention", f"""SELECT (SELECT count(*) FROM raw_run) AS initial_records, count(*) AS final_records,
  count(DISTINCT trip_id) AS unique_trips, count(DISTINCT deviceid) AS unique_devices, min(timestamp_utc) AS start_time,
  max(timestamp_utc) AS end_time, {s6('count(*) * 100.0 / (SELECT count(*) FROM raw_run)')} AS retention_rate_pct FROM clean_run""",
  ("raw_run", "clean_run"))
def retention(spark, d):
    raw = T.raw_run_times(spark, d)
    out = cleaning.retention(raw, cleaning.clean_run_times(raw), "trip_id", "deviceid", "timestamp_utc")
    return rounded(out.withColumns({c: clean_time(c) for c in ("start_time", "end_time")}), "retention_rate_pct")


# --- topology and joins -----------------------------------------------------------------

@query("d01_trips_routes", "SELECT t.trip_id, r.route_short_name FROM trips t JOIN routes r USING (route_id)", ("trips", "routes"))
def trips_routes(spark, d):
    t = T.gtfs(spark, d)
    return topology.trips_with_routes(t["trips"], t["routes"]).select("trip_id", "route_short_name")


@query("d02_stop_times_join", """SELECT t.route_id, count(*) AS stop_times, min(arrival_time) AS first_arrival
  FROM stop_times s JOIN trips t USING (trip_id) GROUP BY 1""", ("stop_times", "trips"))
def stop_times_join(spark, d):
    t = T.gtfs(spark, d)
    return topology.with_stop_times(t["trips"], t["stop_times"]).groupBy("route_id").agg(
        F.count(F.lit(1)).alias("stop_times"), F.min("arrival_time").alias("first_arrival"))


@query("d03_stop_positions_join", f"""SELECT stop_sequence, count(*) AS records, {s6('avg(stop_lat)')} AS mean_lat,
  {s6('avg(stop_lon)')} AS mean_lon FROM schedule GROUP BY 1""", ("schedule",))
def stop_positions_join(spark, d):
    out = T.schedule(spark, d).groupBy("stop_sequence").agg(
        F.count(F.lit(1)).alias("records"), F.avg("stop_lat").alias("mean_lat"), F.avg("stop_lon").alias("mean_lon"))
    return rounded(out, "mean_lat", "mean_lon")


@query("d04_first_trips", "SELECT trip_id, route_id FROM trips ORDER BY trip_id LIMIT 100", ("trips",))
def first_trips(spark, d):
    return topology.first_trips(T.gtfs(spark, d)["trips"], 100).select("trip_id", "route_id")


def _sequence_query(name: str, columns: list[str], floats: list[str] = []):
    picked = ", ".join(f"{s6(c)} AS {c}" if c in floats else c for c in columns)

    @query(name, f"SELECT trip_id, stop_sequence, l_partkey, l_suppkey, {picked} FROM sequences", ("sequences",))
    def run(spark, d):
        rows = T.sequences(spark, d).select("trip_id", "stop_sequence", "l_partkey", "l_suppkey", *columns)
        return rounded(rows, *floats)
    return run


_sequence_query("d05_next_stop", ["next_stop_id", "next_stop_lat", "next_stop_lon"])
_sequence_query("d06_segment_distance", ["segment_distance_km"], ["segment_distance_km"])
_sequence_query("d07_stops_remaining", ["stops_remaining"])
_sequence_query("d08_cumulative_distance", ["cumulative_distance_km"], ["cumulative_distance_km"])

_ROUTE_STOPS = """SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS stop_id, CAST(p_partkey % 7 AS INTEGER) AS route_id,
  CASE p_partkey % 3 WHEN 0 THEN 'Kandy-Digana' WHEN 1 THEN 'Digana-Kandy' ELSE 'Elsewhere' END AS direction FROM part"""


def _route_stops(spark, d):
    k = F.col("p_partkey")
    return T.table(spark, d, "part").select(
        k, k.cast("string").alias("stop_id"), (k % 7).cast("int").alias("route_id"),
        F.when(k % 3 == 0, "Kandy-Digana").when(k % 3 == 1, "Digana-Kandy").otherwise("Elsewhere").alias("direction"))


@query("d09_direction_lookup", f"""SELECT stop_id, CAST(route_id AS VARCHAR) AS route_id, CAST(CASE direction WHEN 'Digana-Kandy' THEN 2 ELSE 1 END AS INTEGER)
  AS direction_id FROM ({_ROUTE_STOPS})""")
def direction_lookup(spark, d):
    return topology.route_topology(_route_stops(spark, d), ["p_partkey"]).select("stop_id", "route_id", "direction_id")


@query("d10_stop_numbers", f"""SELECT stop_id, row_number() OVER (PARTITION BY CASE direction WHEN 'Digana-Kandy' THEN 2 ELSE 1 END
  ORDER BY p_partkey) AS stop_sequence FROM ({_ROUTE_STOPS})""")
def stop_numbers(spark, d):
    return topology.route_topology(_route_stops(spark, d), ["p_partkey"]).select("stop_id", F.col("stop_sequence").cast("long"))


SECONDS_SQL = ("(CAST(split_part(arrival_time, ':', 1) AS BIGINT) * 3600 + CAST(split_part(arrival_time, ':', 2) AS BIGINT) * 60 "
               "+ CAST(split_part(arrival_time, ':', 3) AS BIGINT))")


@query("d11_clock_seconds", f"""SELECT trip_id, stop_sequence, l_partkey, l_suppkey, arrival_time, {SECONDS_SQL} AS arrival_sec
  FROM stop_times""", ("stop_times",))
def clock_seconds(spark, d):
    from fleetlens.functions.geo import clock_seconds as seconds
    return T.gtfs(spark, d)["stop_times"].select(
        "trip_id", "stop_sequence", "l_partkey", "l_suppkey", "arrival_time", seconds(F.col("arrival_time")).alias("arrival_sec"))


DAYS = ("2023-01-01", "2023-01-03")
EXPANDED_SQL = (f"SELECT s.*, d.day AS service_date, d.day + to_seconds({SECONDS_SQL}) AS timestamp_utc FROM sequences s, "
                f"(SELECT CAST(unnest(generate_series(TIMESTAMP '{DAYS[0]}', TIMESTAMP '{DAYS[1]}', INTERVAL 1 DAY)) AS TIMESTAMP) AS day) d")


@query("d12_service_days", f"""SELECT CAST(service_date AS DATE) AS service_date, stop_sequence, count(*) AS records, min(timestamp_utc) AS first_time,
  max(timestamp_utc) AS last_time FROM ({EXPANDED_SQL}) GROUP BY ALL""", ("sequences",))
def service_days(spark, d):
    rows = topology.expand_service_days(T.schedule(spark, d), *DAYS)
    out = rows.groupBy("service_date", "stop_sequence").agg(
        F.count(F.lit(1)).alias("records"), F.min("timestamp_utc").alias("first_time"), F.max("timestamp_utc").alias("last_time"))
    return out.withColumns({c: clean_time(c) for c in ("first_time", "last_time")})


@query("d13_keep_first_trips", """SELECT trip_id, stop_sequence, l_partkey, l_suppkey FROM stop_times WHERE trip_id IN
  (SELECT DISTINCT trip_id FROM stop_times ORDER BY trip_id LIMIT 150)""", ("stop_times",))
def keep_first_trips(spark, d):
    return topology.keep_first_trips(T.gtfs(spark, d)["stop_times"], 150).select("trip_id", "stop_sequence", "l_partkey", "l_suppkey")


@query("d14_service_timestamps", f"SELECT trip_id, stop_sequence, l_partkey, l_suppkey, timestamp_utc FROM ({EXPANDED_SQL})", ("sequences",))
def service_timestamps(spark, d):
    """All service days."""
    rows = topology.expand_service_days(T.gtfs(spark, d)["stop_times"], *DAYS)
    kept = rows.join(T.gtfs(spark, d)["trips"].select("trip_id"), "trip_id", "left_semi")
    return kept.select("trip_id", "stop_sequence", "l_partkey", "l_suppkey", clean_time("timestamp_utc").alias("timestamp_utc"))


_TRAJECTORY = f"""SELECT *, date_diff('microsecond', timestamp_utc, next_time) / 1e6 AS segment_time_sec FROM (SELECT *, lead(timestamp_utc) OVER (
  PARTITION BY trip_id, service_date ORDER BY timestamp_utc, l_partkey, l_suppkey, l_extendedprice) AS next_time FROM ({EXPANDED_SQL}))"""
_SPEED = """coalesce(CASE WHEN segment_time_sec > 0 THEN least(greatest(segment_distance_km / (segment_time_sec / 3600.0), 5.0), 75.0) END, 25.0)"""


def _trajectory(spark, d):
    blocks = T.stop_blocks(spark, d)
    rows = topology.expand_service_days(T.sequences(spark, d, blocks), *DAYS)
    # a trip that fits a block does so on every service day
    return topology.scheduled_trajectory(rows, ["timestamp_utc", "l_partkey", "l_suppkey", "l_extendedprice"],
                                         blocks=blocks if blocks.fits(["trip_id"]) else None)


@query("d15_scheduled_speed", f"""SELECT CAST(service_date AS DATE) AS service_date, stop_sequence, count(segment_time_sec) AS segments,
  {s6('avg(segment_time_sec)')} AS mean_segment_sec, {s6(f'avg({_SPEED})')} AS mean_speed FROM ({_TRAJECTORY}) GROUP BY ALL""", ("sequences",))
def scheduled_speed(spark, d):
    out = _trajectory(spark, d).groupBy("service_date", "stop_sequence").agg(
        F.count("segment_time_sec").alias("segments"), F.avg("segment_time_sec").alias("mean_segment_sec"),
        F.avg("current_speed_kmh").alias("mean_speed"))
    return rounded(out, "mean_segment_sec", "mean_speed")


@query("d16_vehicle_id", "SELECT trip_id, 'BUS_' || list_extract(string_split(block_id, '_'), -1) AS vehicle_id FROM trips", ("trips",))
def vehicle_id(spark, d):
    return T.gtfs(spark, d)["trips"].select("trip_id", topology.vehicle_id("block_id").alias("vehicle_id"))


@query("d17_congestion_flags", f"""SELECT stop_sequence, CAST(sum(CASE WHEN {_SPEED} < 15 THEN 1 ELSE 0 END) AS BIGINT) AS congested,
  count(*) AS at_stops, {s6('max(stop_lat)')} AS north FROM ({_TRAJECTORY}) GROUP BY 1""", ("sequences",))
def congestion_flags(spark, d):
    out = _trajectory(spark, d).groupBy("stop_sequence").agg(
        F.sum("is_congested").alias("congested"), F.sum("is_at_stop").alias("at_stops"), F.max("latitude").alias("north"))
    return rounded(out, "north")


@query("d18_hour_floor_weather_join", f"""SELECT event_id, {s6('temperature_2m')} AS temperature_2m, {s6('rain')} AS rain,
  {s6('wind_speed_10m')} AS wind_speed_10m, CAST(weather_code AS BIGINT) AS weather_code FROM joined""", ("joined",))
def hour_floor_weather_join(spark, d):
    out = T.with_weather(spark, d).select("event_id", "temperature_2m", "rain", "wind_speed_10m", F.col("weather_code").cast("long"))
    return rounded(out, "temperature_2m", "rain", "wind_speed_10m")


@query("d18_weather_match_rate", f"""SELECT count(*) AS total_rows, count(temperature_2m) AS matched_rows,
  {s6('count(temperature_2m) * 100.0 / count(*)')} AS match_rate_pct FROM joined""", ("joined",))
def weather_match_rate(spark, d):
    return rounded(topology.match_rate(T.with_weather(spark, d)), "match_rate_pct")


@query("d20_union_common", """SELECT segment, count(*) AS records FROM (SELECT trip_id, CAST(segment AS INTEGER) AS segment FROM obs
  UNION ALL SELECT trip_id, segment FROM clean_run) GROUP BY 1""", ("obs", "clean_run"))
def union_common(spark, d):
    clean = cleaning.clean_run_times(T.raw_run_times(spark, d)).drop("route_id")
    return topology.union_common(T.observations(spark, d), clean).groupBy("segment").agg(F.count(F.lit(1)).alias("records"))


@query("d21_disjoint_parts", """SELECT count(*) AS shared_rows, CAST(count(*) = 0 AS BIGINT) AS is_disjoint FROM split_obs a
  WHERE split = 'train' AND event_id IN (SELECT event_id FROM split_obs WHERE split = 'stream')""", ("split_obs",))
def disjoint_parts(spark, d):
    rows = T.split_rows(spark, d)
    return topology.overlap(rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "stream"), ["event_id"])


# --- labels -----------------------------------------------------------------------------

_NEXT = """SELECT *, date_diff('microsecond', timestamp_utc, lead(timestamp_utc) OVER (PARTITION BY trip_id ORDER BY timestamp_utc, event_id))
  / 1e6 AS eta FROM obs"""
# events of one user are hours apart, so the plausible range is widened to a day
DAY_BOUNDS = (1.0, 86400.0)


def _next_labels(spark, d):
    return labels.time_to_next_record(T.observations(spark, d), T.TIME_ORDER, blocks=T.time_blocks(spark, d))


@query("e01_time_to_next_record", f"SELECT event_id, {s6('eta')} AS eta_sec FROM ({_NEXT})", ("obs",))
def time_to_next_record(spark, d):
    return rounded(_next_labels(spark, d).select("event_id", F.col(schemas.TARGET).alias("eta_sec")), "eta_sec")


@query("e02_time_to_arrival", f"""SELECT CAST(service_date AS DATE) AS service_date, count(segment_time_sec) AS labelled,
  {s6('avg(segment_time_sec)')} AS mean_eta FROM ({_TRAJECTORY}) GROUP BY 1""", ("sequences",))
def time_to_arrival(spark, d):
    out = labels.time_to_arrival(_trajectory(spark, d)).groupBy("service_date").agg(
        F.count(schemas.TARGET).alias("labelled"), F.avg(schemas.TARGET).alias("mean_eta"))
    return rounded(out, "mean_eta")


@query("e03_label_rejections", f"""SELECT count(*) AS total_rows, count(*) - count(eta) AS missing_label,
  count(*) FILTER (WHERE eta <= 1) AS too_small, count(*) FILTER (WHERE eta > 86400) AS too_large,
  count(*) FILTER (WHERE eta BETWEEN 1 AND 86400) AS valid_rows FROM ({_NEXT})""", ("obs",))
def label_rejections(spark, d):
    return labels.rejections(_next_labels(spark, d), DAY_BOUNDS)


@query("e04_valid_labels", f"SELECT event_id, {s6('eta')} AS eta_sec FROM ({_NEXT}) WHERE eta BETWEEN 1 AND 86400", ("obs",))
def valid_labels(spark, d):
    rows = labels.valid_labels(_next_labels(spark, d), DAY_BOUNDS)
    return rounded(rows.select("event_id", F.col(schemas.TARGET).alias("eta_sec")), "eta_sec")


@query("e05_run_time_labels", """SELECT count(*) AS total_rows, count(*) - count(run_time_in_seconds) AS missing_label,
  count(*) FILTER (WHERE run_time_in_seconds < 3) AS too_small, count(*) FILTER (WHERE run_time_in_seconds > 3600) AS too_large,
  count(*) FILTER (WHERE run_time_in_seconds BETWEEN 3 AND 3600) AS valid_rows FROM raw_run""", ("raw_run",))
def run_time_labels(spark, d):
    return labels.rejections(labels.run_time_target(T.raw_run_times(spark, d)), labels.RUN_TIME_BOUNDS, lower_inclusive=False)


@query("e06_label_distribution", f"""SELECT count(*) AS count, {s6('avg(x)')} AS mean_sec, {s6('stddev_samp(x)')} AS std_sec, {s6('min(x)')} AS min_sec,
  {s6('max(x)')} AS max_sec, {s6('median(x)')} AS median_sec, """ + ", ".join(
    f"{s6(f'quantile_cont(x, {p})')} AS {n}_sec" for n, p in quality.QUANTILE_NAMES.items()) +
  " FROM (SELECT run_time_in_seconds AS x FROM raw_run WHERE run_time_in_seconds BETWEEN 3 AND 3600)", ("raw_run",))
def label_distribution(spark, d):
    rows = labels.valid_labels(labels.run_time_target(T.raw_run_times(spark, d)), labels.RUN_TIME_BOUNDS)
    out = labels.label_distribution(rows)
    return rounded(out, *[c for c in out.columns if c != "count"])


# --- features ---------------------------------------------------------------------------

def _feature_query(name: str, columns: list[str], floats: list[str] = []):
    picked = ", ".join(f"{s6(c)} AS {c}" if c in floats else f"CAST({c} AS BIGINT) AS {c}" for c in columns)

    @query(name, f"SELECT event_id, {picked} FROM feats", ("feats",))
    def run(spark, d):
        rows = T.feature_table(spark, d).select(
            "event_id", *[F.col(c) if c in floats else F.col(c).cast("long").alias(c) for c in columns])
        return rounded(rows, *floats)
    return run


_feature_query("f01_calendar", ["hour", "minute", "day_of_week", "is_weekend"])
_CYCLES = ["sin_hour", "cos_hour", "sin_time_of_day", "cos_time_of_day"]
_feature_query("f02_cyclical", _CYCLES, _CYCLES)
_feature_query("f03_peak", ["is_peak_period"])


@query("f04_distances", f"""SELECT stop_sequence, {s6('avg(segment_distance_km)')} AS mean_next_km,
  {s6('avg(segment_distance_km * stops_remaining)')} AS mean_remaining_km FROM sequences GROUP BY 1""", ("sequences",))
def distances(spark, d):
    rows = T.sequences(spark, d).withColumns({"latitude": F.col("stop_lat"), "longitude": F.col("stop_lon")})
    out = features.distance_features(rows).groupBy("stop_sequence").agg(
        F.avg("distance_to_next_stop_km").alias("mean_next_km"), F.avg("distance_remaining_on_route_km").alias("mean_remaining_km"))
    return rounded(out, "mean_next_km", "mean_remaining_km")


_W3 = "OVER (PARTITION BY trip_id ORDER BY timestamp_utc, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
_SPEEDS = ["recent_speed_mean", "recent_speed_std", "recent_speed_min", "recent_speed_max"]


@query("f05_rolling_speed", f"""SELECT event_id, {s6(f'avg(run_time_in_seconds) {_W3}')} AS recent_speed_mean,
  {s6(f'coalesce(stddev_samp(run_time_in_seconds) {_W3}, 0)')} AS recent_speed_std,
  {s6(f'min(run_time_in_seconds) {_W3}')} AS recent_speed_min, {s6(f'max(run_time_in_seconds) {_W3}')} AS recent_speed_max FROM obs""", ("obs",))
def rolling_speed(spark, d):
    rows = features.rolling_speed(T.observations(spark, d), T.TIME_ORDER, "run_time_in_seconds", blocks=T.time_blocks(spark, d))
    return rounded(rows.select("event_id", *_SPEEDS), *_SPEEDS)


_feature_query("f06_trip_progress", ["segments_completed", "segments_remaining", "trip_progress_ratio"], ["trip_progress_ratio"])
_feature_query("f07_previous_run_time", ["previous_segment_run_time"], ["previous_segment_run_time"])
_feature_query("f08_segment_history", ["historical_segment_time_mean"], ["historical_segment_time_mean"])


@query("f08_causal_history", f"""SELECT event_id, {s6('''avg(run_time_in_seconds) OVER (PARTITION BY direction, segment
  ORDER BY timestamp_utc, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)''')} AS historical_segment_time_mean FROM obs""", ("obs",))
def causal_history(spark, d):
    rows = features.segment_history(T.observations(spark, d), causal=True, order=T.TIME_ORDER, blocks=T.time_blocks(spark, d))
    return rounded(rows.select("event_id", "historical_segment_time_mean"), "historical_segment_time_mean")


_ROLL = ["rolling_prev_segment_mean", "rolling_prev_segment_std"]
_feature_query("f09_rolling_previous", _ROLL, _ROLL)
_feature_query("f10_elapsed_time", ["cumulative_trip_time_sec"], ["cumulative_trip_time_sec"])
_feature_query("f11_delay_ratio", ["segment_delay_ratio", "congestion_proxy"], ["segment_delay_ratio"])
_feature_query("f12_weather_imputation", schemas.WEATHER_FEATURES, schemas.WEATHER_FEATURES)


@query("f13_optional_defaults", f"""SELECT event_id, {s6('coalesce(temperature_2m, 0)')} AS temperature_2m, CAST(0 AS BIGINT) AS direction_id,
  CAST(0.35 AS DOUBLE) AS simulated_passenger_occupancy_ratio, CAST(0 AS DOUBLE) AS dwell_time_sec FROM joined""", ("joined",))
def optional_defaults(spark, d):
    rows = features.optional_defaults(T.with_weather(spark, d))
    return rounded(rows.select("event_id", "temperature_2m", F.col("direction_id").cast("long"),
                               "simulated_passenger_occupancy_ratio", "dwell_time_sec"), "temperature_2m")


@query("f14_dwell_default", "SELECT event_id, CAST(CASE WHEN at_stop = 1 THEN 20 ELSE 0 END AS DOUBLE) AS dwell_time_sec FROM positions", ("positions",))
def dwell_default(spark, d):
    rows = features.optional_defaults(T.positions(spark, d).withColumnRenamed("at_stop", "is_at_stop"))
    return rows.select("event_id", "dwell_time_sec")


AUDITED = list(schemas.NUMERICAL_FEATURES)


@query("f15_leakage_audit", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {s6(f'corr({c}, run_time_in_seconds)')} AS label_correlation, "
    f"{s6(f'avg(CASE WHEN {c} = run_time_in_seconds THEN 1 ELSE 0 END)')} AS equal_share, CAST(1 AS BIGINT) AS name_allowed FROM feats"
    for c in AUDITED), ("feats",))
def leakage_audit(spark, d):
    rows = T.feature_table(spark, d)
    return rounded(features.leakage_audit(rows, AUDITED, "run_time_in_seconds"), "label_correlation", "equal_share")


_ORIGIN = {c: o for o, names in features.PROVENANCE.items() for c in names}


@query("f17_feature_catalog", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS non_null, {s6(f'avg({c})')} AS mean, {s6(f'min({c})')} AS min, {s6(f'max({c})')} AS max, "
    f"'{_ORIGIN[c]}' AS provenance, 'numerical' AS feature_type FROM feats" for c in schemas.NUMERICAL_FEATURES), ("feats",))
def feature_catalog(spark, d):
    return rounded(features.feature_catalog(T.feature_table(spark, d)), "mean", "min", "max")


# --- splits -----------------------------------------------------------------------------

@query("g01_chronological_split", "SELECT event_id, split FROM split_obs", ("split_obs",))
def chronological_split(spark, d):
    return T.split_rows(spark, d).select("event_id", "split")


@query("g02_split_report", f"""SELECT split, count(*) AS records, min(timestamp_utc) AS start_time_utc, max(timestamp_utc) AS end_time_utc,
  count(DISTINCT trip_id) AS unique_trips, count(DISTINCT deviceid) AS unique_devices,
  {s6('count(*) * 100.0 / max(n)')} AS percentage FROM split_obs GROUP BY 1""", ("split_obs",))
def split_report(spark, d):
    out = splits.split_report(T.split_rows(spark, d), "timestamp_utc", "trip_id", "deviceid")
    return rounded(out.withColumns({c: clean_time(c) for c in ("start_time_utc", "end_time_utc")}), "percentage")


_STREAM = """SELECT *, CASE WHEN i2 < least(greatest(floor(n2 * 0.8::DOUBLE), 1), n2 - 1) THEN 'train' ELSE 'holdout' END AS part FROM (
  SELECT *, row_number() OVER (ORDER BY timestamp_utc, event_id) - 1 AS i2, count(*) OVER () AS n2 FROM split_obs WHERE split = 'stream')"""


@query("g03_stream_split", f"SELECT event_id, part FROM ({_STREAM})", ("split_obs",))
def stream_split(spark, d):
    stream = T.split_rows(spark, d).filter(F.col("split") == "stream").drop("split")
    return splits.head_and_holdout(stream, T.TIME_ORDER).select("event_id", "part")


@query("g04_target_fallback", f"SELECT event_id, {s6('run_time_in_seconds')} AS eta_to_next_stop_sec FROM obs", ("obs",))
def target_fallback(spark, d):
    rows = T.observations(spark, d).withColumnRenamed("run_time_in_seconds", "actual_eta_sec")
    return rounded(splits.with_target(rows).select("event_id", schemas.TARGET), schemas.TARGET)


def _candidate(spark, d):
    rows = T.split_rows(spark, d)
    history = rows.filter(F.col("split") == "train").drop("split")
    stream = rows.filter(F.col("split") == "stream").drop("split")
    train, recent = splits.candidate_dataset(history, stream, T.TIME_ORDER)
    return train, rows.filter(F.col("split") == "validation").drop("split"), recent


@query("g05_candidate_dataset", f"""SELECT event_id, 'train' AS role FROM split_obs WHERE split = 'train'
  UNION ALL SELECT event_id, CASE part WHEN 'train' THEN 'train' ELSE 'recent_holdout' END FROM ({_STREAM})""", ("split_obs",))
def candidate_dataset(spark, d):
    train, _, recent = _candidate(spark, d)
    return train.select("event_id", F.lit("train").alias("role")).unionByName(
        recent.select("event_id", F.lit("recent_holdout").alias("role")))


_HASHED = ["event_id", "trip_id", "deviceid", "direction", "segment", "timestamp_utc", "run_time_in_seconds", "length", "event_type"]


def _hash_sql(source: str) -> str:
    return f"(SELECT {_digest_sql(_HASHED)} FROM ({source}))"


_COLUMNS = ", ".join(_HASHED)
_TRAIN = f"SELECT {_COLUMNS} FROM split_obs WHERE split = 'train' UNION ALL SELECT {_COLUMNS} FROM ({_STREAM}) WHERE part = 'train'"
_RECENT = f"SELECT {_COLUMNS} FROM ({_STREAM}) WHERE part = 'holdout'"
_ORIGINAL = f"SELECT {_COLUMNS} FROM split_obs WHERE split = 'validation'"


@query("g06_provenance", f"""SELECT *, CAST(0 AS BIGINT) AS shared_rows, CAST(1 AS BIGINT) AS is_disjoint,
  {s6('recent_holdout_rows / (train_rows + recent_holdout_rows)')} AS holdout_share FROM (SELECT
  (SELECT count(*) FROM ({_TRAIN})) AS train_rows, {_hash_sql(_TRAIN)} AS train_hash,
  (SELECT count(*) FROM ({_ORIGINAL})) AS original_holdout_rows, {_hash_sql(_ORIGINAL)} AS original_holdout_hash,
  (SELECT count(*) FROM ({_RECENT})) AS recent_holdout_rows, {_hash_sql(_RECENT)} AS recent_holdout_hash)""", ("split_obs",))
def provenance(spark, d):
    train, original, recent = _candidate(spark, d)
    return rounded(splits.provenance(train, original, recent, ["event_id"], _HASHED), "holdout_share")
