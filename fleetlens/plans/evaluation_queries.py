"""Queries over prediction errors, what-ifs and event records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import labels as L
from fleetlens.operators import evaluation, events, whatif
from fleetlens.plans import testbed as T
from fleetlens.plans.registry import clean_time, cte, half_up, query, r6, rounded, s6
from fleetlens.session import materialize

ABS = "absolute_error_sec"
METRICS = ["mae_sec", "rmse_sec", "r2", "mape_pct", "smape_pct", "non_positive_pct", "excessive_pct",
           "median_ae_sec", "p90_error_sec", "p95_error_sec", "p99_error_sec"]


def metrics_sql(source: str, keys: str = "", gate: bool = False, y: str = "actual", p: str = "predicted") -> str:
    """The metric list as one aggregation."""
    e = f"abs({y} - {p})"
    if gate:
        smape = f"avg(CASE WHEN {y} >= 10 THEN 2 * {e} / CASE WHEN abs({y}) + abs({p}) = 0 THEN 1 ELSE abs({y}) + abs({p}) END END) * 100"
        over = f"{p} > 3600"
    else:
        smape = f"avg(CASE WHEN abs({y}) + abs({p}) > 1e-6 THEN 2 * {e} / (abs({y}) + abs({p})) END) * 100"
        over = f"{p} >= 3600"
    parts = {
        "mae_sec": f"avg({e})", "rmse_sec": f"sqrt(avg({e} * {e}))", "r2": f"1 - avg({e} * {e}) / nullif(var_pop({y}), 0)",
        "mape_pct": f"avg(CASE WHEN {y} >= 10 THEN {e} / {y} END) * 100", "smape_pct": f"coalesce({smape}, 0)",
        "non_positive_pct": f"count(*) FILTER (WHERE {p} <= 0) * 100.0 / count(*)",
        "excessive_pct": f"count(*) FILTER (WHERE {over}) * 100.0 / count(*)",
        "median_ae_sec": f"median({e})", "p90_error_sec": f"quantile_cont({e}, 0.9)",
        "p95_error_sec": f"quantile_cont({e}, 0.95)", "p99_error_sec": f"quantile_cont({e}, 0.99)"}
    head = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return (f"SELECT {head}count(*) AS samples, count(*) FILTER (WHERE {p} <= 0) AS non_positive_count, "
            f"count(*) FILTER (WHERE {over}) AS excessive_count, "
            + ", ".join(f"{s6(e_)} AS {n}" for n, e_ in parts.items()) + f" FROM {source}{group}")


@query("l01_regression_metrics", metrics_sql("preds"), ("preds",))
def regression_metrics(spark, d):
    return rounded(evaluation.regression_metrics(T.scored(spark, d), "actual", "predicted", blocks=T.fits(spark, d, ABS)), *METRICS)


@query("l02_gate_metrics", metrics_sql("preds", gate=True), ("preds",))
def gate_metrics(spark, d):
    return rounded(evaluation.regression_metrics(T.scored(spark, d), "actual", "predicted", gate_variant=True, blocks=T.fits(spark, d, ABS)), *METRICS)


@query("l02_metrics_by_segment", metrics_sql("preds", "segment"), ("preds",))
def metrics_by_segment(spark, d):
    return rounded(evaluation.regression_metrics(T.scored(spark, d), "actual", "predicted", ["segment"], blocks=T.fits(spark, d, ABS)), *METRICS)


def _case(column: str, edges, names) -> str:
    arms = " ".join(f"WHEN {column} <= {high} THEN '{name}'" for high, name in zip(edges[1:], names))
    return f"CASE WHEN {column} <= {edges[0]} THEN NULL {arms} END"


_WEATHER_CASE = "CASE " + " ".join(
    f"WHEN CAST(coalesce(weather_code, 0) AS INTEGER) IN ({', '.join(map(str, codes))}) THEN '{name}'" for name, codes in L.WEATHER.items()
) + " ELSE 'Weather Code ' || CAST(CAST(weather_code AS INTEGER) AS VARCHAR) END"
_DIMENSIONS = {
    "by_direction": f"CASE direction WHEN 1 THEN '{L.DIRECTIONS[1]}' ELSE '{L.OTHER_DIRECTION}' END",
    "by_segment": "'Segment_' || segment", "by_hour": "printf('%02d:00', hour)",
    "by_day_of_week": f"{L.WEEKDAYS!r}[day_of_week + 1]",
    "by_peak_period": "CASE is_peak_period WHEN 1 THEN 'Peak Period' ELSE 'Off-Peak' END",
    "by_weather_condition": _WEATHER_CASE, "by_precipitation_tier": _case("precipitation", *L.PRECIPITATION_TIERS),
    "by_congestion_tier": _case("congestion_proxy", *L.CONGESTION_TIERS), "by_target_range": _case("actual", *L.TARGET_TIERS)}
cte("dimensions", "SELECT *, abs(actual - predicted) / greatest(actual, 10) * 100 AS pct, "
    + ", ".join(f"{e} AS {n}" for n, e in _DIMENSIONS.items()) + " FROM scored", "scored")
_STRATA = ["mae_sec", "rmse_sec", "mape_pct", "mean_actual_sec", "mean_pred_sec", "median_ae_sec", "p90_error_sec"]


def _strata_sql(names) -> str:
    sets = ", ".join(f"({n})" for n in names)
    dimension = "CASE " + " ".join(f"WHEN grouping({n}) = 0 THEN '{n}'" for n in names) + " END"
    return f"""SELECT * FROM (SELECT {dimension} AS dimension, coalesce({', '.join(names)}) AS label, count(*) AS records,
      {s6('avg(absolute_error_sec)')} AS mae_sec, {s6('sqrt(avg(absolute_error_sec * absolute_error_sec))')} AS rmse_sec,
      {s6('avg(pct)')} AS mape_pct, {s6('avg(actual)')} AS mean_actual_sec, {s6('avg(predicted)')} AS mean_pred_sec,
      {s6('median(absolute_error_sec)')} AS median_ae_sec, {s6('quantile_cont(absolute_error_sec, 0.9)')} AS p90_error_sec
      FROM dimensions GROUP BY GROUPING SETS ({sets})) WHERE label IS NOT NULL"""


@query("l03_stratified_errors", _strata_sql(list(_DIMENSIONS)), ("dimensions",))
def stratified_errors(spark, d):
    rows = T.stored_scored(spark, d, "direction", "segment", "hour", "day_of_week", "is_peak_period", "weather_code", "precipitation", "congestion_proxy", "actual", "predicted")
    return rounded(evaluation.stratified_errors(rows, blocks=T.fits(spark, d, ABS)), *_STRATA)


@query("l04_percent_error", f"SELECT event_id, {s6('pct')} AS pct_error FROM dimensions", ("dimensions",))
def percent_error(spark, d):
    return T.scored(spark, d).select("event_id", r6(evaluation.percent_error()).alias("pct_error"))


@query("l05_weather_labels", "SELECT by_weather_condition AS label, count(*) AS records FROM dimensions GROUP BY 1", ("dimensions",))
def weather_labels(spark, d):
    return T.scored(spark, d).groupBy(L.weather_label(F.col("weather_code")).alias("label")).agg(F.count(F.lit(1)).alias("records"))


@query("l06_tiers", """SELECT by_precipitation_tier AS precipitation_tier, by_target_range AS target_range, count(*) AS records
  FROM dimensions GROUP BY ALL""", ("dimensions",))
def tiers(spark, d):
    rows = evaluation.error_dimensions(T.scored(spark, d))
    return rows.groupBy("precipitation_tier", "target_range").agg(F.count(F.lit(1)).alias("records"))


@query("l07_label_maps", """SELECT event_id, by_direction AS direction_name, by_segment AS segment_name, by_hour AS hour_name,
  by_day_of_week AS weekday_name, by_peak_period AS peak_name FROM dimensions""", ("dimensions",))
def label_maps(spark, d):
    return evaluation.error_dimensions(T.scored(spark, d)).select(
        "event_id", "direction_name", "segment_name", "hour_name", "weekday_name", "peak_name")


@query("l08_actual_vs_predicted", f"""SELECT event_id, trip_id, actual, {half_up('predicted')} AS predicted,
  {half_up('signed_error_sec')} AS signed_error_sec, {half_up('absolute_error_sec')} AS absolute_error_sec,
  {half_up('pct')} AS percentage_error FROM dimensions""", ("dimensions",))
def actual_vs_predicted(spark, d):
    return evaluation.actual_vs_predicted(T.scored(spark, d), ["event_id", "trip_id"])


@query("l09_residual_histogram", f"""SELECT bin, {s6('-150 + bin * 3.75')} AS bin_start, count(*) AS records,
  {s6('count(*) / (sum(count(*)) OVER () * 3.75)')} AS density FROM (SELECT CAST(least(floor((actual - predicted + 150) / 3.75), 79) AS BIGINT) AS bin
  FROM preds WHERE actual - predicted BETWEEN -150 AND 150) GROUP BY 1""", ("preds",))
def residual_histogram(spark, d):
    return rounded(evaluation.residual_histogram(T.scored(spark, d)), "bin_start", "density")


@query("l09_residual_center", f"""SELECT {s6('avg(actual - predicted)')} AS mean_residual, {s6('median(actual - predicted)')} AS median_residual
  FROM preds""", ("preds",))
def residual_center(spark, d):
    return rounded(evaluation.residual_center(T.scored(spark, d), T.fits(spark, d, "r")), "mean_residual", "median_residual")


@query("l10_error_cdf", f"""SELECT e AS absolute_error_sec, CAST(sum(c) AS BIGINT) AS records, {s6('max(cd)')} AS cdf FROM (
  SELECT {s6('absolute_error_sec')} AS e, 1 AS c, cume_dist() OVER (ORDER BY {s6('absolute_error_sec')}) AS cd FROM scored) GROUP BY 1""", ("scored",))
def error_cdf(spark, d):
    rows = T.scored(spark, d)
    # both inputs are rounded so that equal errors are equal in both engines
    rows = rows.select(r6("absolute_error_sec").alias("actual"), F.lit(0.0).alias("predicted"))
    return evaluation.error_cdf(rows, (T.fits(spark, d, ABS) or {}).get(ABS)).select("absolute_error_sec", "records", r6("cdf").alias("cdf"))


_BUCKETS = "CASE " + " ".join(f"WHEN absolute_error_sec >= {low} THEN '{n}'" for low, n in reversed(list(zip(*L.ERROR_BUCKETS)))) + " END"


@query("l11_error_buckets", f"SELECT {_BUCKETS} AS bucket, count(*) AS records FROM scored GROUP BY 1", ("scored",))
def error_buckets(spark, d):
    return evaluation.error_buckets(T.scored(spark, d))


@query("l12_mae_by_segment", f"SELECT segment, count(*) AS records, {s6('avg(absolute_error_sec)')} AS mae_sec FROM scored GROUP BY 1", ("scored",))
def mae_by_segment(spark, d):
    return rounded(evaluation.mae_by(T.scored(spark, d), "segment"), "mae_sec")


@query("l12_mae_by_hour", f"SELECT CAST(hour AS BIGINT) AS hour, count(*) AS records, {s6('avg(absolute_error_sec)')} AS mae_sec FROM scored GROUP BY 1", ("scored",))
def mae_by_hour(spark, d):
    return rounded(evaluation.mae_by(T.scored(spark, d), "hour"), "mae_sec").withColumn("hour", F.col("hour").cast("long"))


@query("l13_scatter_sample", "SELECT event_id, actual, predicted FROM preds ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 5000", ("preds",))
def scatter_sample(spark, d):
    return evaluation.scatter_sample(T.scored(spark, d).select("event_id", "actual", "predicted"), "event_id")


@query("l13_leading_slice", "SELECT event_id, actual, predicted FROM preds ORDER BY timestamp_utc, event_id LIMIT 150", ("preds",))
def leading_slice(spark, d):
    rows = T.scored(spark, d).select("event_id", "actual", "predicted", "timestamp_utc")
    return evaluation.leading_slice(rows, T.TIME_ORDER).drop("timestamp_utc")


# --- what-ifs ---------------------------------------------------------------------------

TOUCHED = ["segment_delay_ratio", "previous_segment_run_time", "rolling_prev_segment_mean", "cumulative_trip_time_sec",
           "precipitation", "rain", "relative_humidity_2m", "actual"]
FLAGS = ["is_peak_period", "congestion_proxy", "weather_code"]
PEAK = "((hour * 60 + minute) BETWEEN 420 AND 540 OR (hour * 60 + minute) BETWEEN 990 AND 1110)"


def _scaled(column: str, factor: float, i: float) -> str:
    return f"{column} * {1.0 + factor * i!r}::DOUBLE"


def step_sql(kind: str, i: float) -> dict[str, str]:
    """New column values of one disturbance step."""
    if kind == "rush":
        return {"is_peak_period": "1", "congestion_proxy": "1", "segment_delay_ratio": half_up(_scaled("segment_delay_ratio", 0.60, i), 4),
                "previous_segment_run_time": half_up(_scaled("previous_segment_run_time", 0.35, i)),
                "rolling_prev_segment_mean": half_up(_scaled("rolling_prev_segment_mean", 0.35, i)),
                "actual": half_up(_scaled("actual", 0.70, i))}
    if kind == "rain":
        return {"precipitation": half_up(f"greatest(precipitation, {0.0 + 16.0 * i!r}::DOUBLE)"), "rain": half_up(f"greatest(rain, {0.0 + 14.0 * i!r}::DOUBLE)"),
                "relative_humidity_2m": half_up(f"least(greatest(relative_humidity_2m, {88.0 + 10.0 * i!r}::DOUBLE), 100.0::DOUBLE)", 1),
                "weather_code": "65" if i > 0.5 else "63", "segment_delay_ratio": half_up(_scaled("segment_delay_ratio", 0.25, i), 4),
                "actual": half_up(_scaled("actual", 0.35, i))}
    if kind == "surge":
        return {"congestion_proxy": "1", "segment_delay_ratio": half_up(_scaled("segment_delay_ratio", 1.10, i), 4),
                "previous_segment_run_time": half_up(_scaled("previous_segment_run_time", 0.75, i)),
                "rolling_prev_segment_mean": half_up(_scaled("rolling_prev_segment_mean", 0.75, i)),
                "actual": half_up(_scaled("actual", 1.05, i))}
    if kind == "incident":
        return {"congestion_proxy": "1", "segment_delay_ratio": half_up(_scaled("segment_delay_ratio", 1.50, i), 4),
                "actual": half_up(f"({_scaled('actual', 1.40, i)} + {80.0 * i!r}::DOUBLE)")}
    return {"cumulative_trip_time_sec": half_up(f"(cumulative_trip_time_sec + {90.0 * i!r}::DOUBLE)"),
            "previous_segment_run_time": half_up(f"(previous_segment_run_time + {40.0 * i!r}::DOUBLE)"),
            "actual": half_up(f"(actual + {65.0 * i!r}::DOUBLE)")}


SCENARIO_SQL = {
    "BASELINE": ((), 0.0, "false"), "RUSH_HOUR": (("rush",), 0.75, PEAK), "HEAVY_RAIN": (("rain",), 0.80, "true"),
    "CONGESTION_SURGE": (("surge",), 0.70, "true"), "ROAD_INCIDENT": (("incident",), 0.85, "segment IN (8, 9, 10)"),
    "DWELL_SURGE": (("dwell",), 0.75, "true"), "COMBINED_DISRUPTION": (("rain", "surge", "dwell"), 0.85, "true")}


def scenario_sql(scenario: str, source: str = "scored") -> str:
    """Rows of one scenario; one nested SELECT per step."""
    steps, i, where = SCENARIO_SQL[scenario]
    sql = f"SELECT *, {where} AS hit FROM {source}"
    for kind in steps:
        replaced = ", ".join(f"CASE WHEN hit THEN {e} ELSE {c} END AS {c}" for c, e in step_sql(kind, i).items())
        sql = f"SELECT * REPLACE ({replaced}) FROM ({sql})"
    return sql


_SCENARIO_COLUMNS = ", ".join([*(f"{s6(c)} AS {c}" for c in TOUCHED), *(f"CAST({c} AS BIGINT) AS {c}" for c in FLAGS)])


def _scenario_query(name: str, scenario: whatif.Scenario):
    @query(name, f"SELECT event_id, CAST(hit AS BIGINT) AS applied, {_SCENARIO_COLUMNS} FROM ({scenario_sql(scenario.scenario_id)})", ("scored",))
    def run(spark, d):
        rows = scenario.apply(T.scored(spark, d))
        return rounded(rows.select("event_id", F.col(whatif.APPLIED).cast("long").alias("applied"), *TOUCHED,
                                   *[F.col(c).cast("long").alias(c) for c in FLAGS]), *TOUCHED)
    return run


@query("m01_activation", f"""SELECT scenario_id, count(*) AS active_rows FROM (
  SELECT 'INCIDENT' AS scenario_id FROM obs WHERE segment IN (8, 9, 10) AND timestamp_utc BETWEEN TIMESTAMP '2024-01-05 08:00:00' AND TIMESTAMP '2024-01-20 10:00:00'
  UNION ALL SELECT 'LATE' FROM obs WHERE timestamp_utc >= TIMESTAMP '2024-01-25 00:00:00'
  UNION ALL SELECT 'RUSH' FROM (SELECT hour(timestamp_utc) AS hour, minute(timestamp_utc) AS minute FROM obs) WHERE {PEAK}) GROUP BY 1""", ("obs",))
def activation(spark, d):
    from dataclasses import replace
    chosen = [replace(whatif.ROAD_INCIDENT, scenario_id="INCIDENT", start="2024-01-05 08:00:00", end="2024-01-20 10:00:00"),
              replace(whatif.HEAVY_RAIN, scenario_id="LATE", start="2024-01-25 00:00:00"),
              replace(whatif.RUSH_HOUR, scenario_id="RUSH"), replace(whatif.DWELL_SURGE, scenario_id="ZERO", intensity=0.0)]
    return whatif.describe(T.observations(spark, d), chosen).filter("affected_rows > 0").select(
        "scenario_id", F.col("affected_rows").alias("active_rows"))


_scenario_query("m02_baseline", whatif.BASELINE)
_scenario_query("m03_rush_hour", whatif.RUSH_HOUR)
_scenario_query("m04_heavy_rain", whatif.HEAVY_RAIN)
_scenario_query("m05_congestion_surge", whatif.CONGESTION_SURGE)
_scenario_query("m06_road_incident", whatif.ROAD_INCIDENT)
_scenario_query("m07_dwell_surge", whatif.DWELL_SURGE)
_scenario_query("m08_combined_disruption", whatif.COMBINED_DISRUPTION)


@query("m09_scenario_catalog", " UNION ALL ".join(
    f"SELECT '{s.scenario_id}' AS scenario_id, count(*) FILTER (WHERE {SCENARIO_SQL[s.scenario_id][2]}) AS affected_rows, '{s.name}' AS name, "
    f"CAST({s.intensity} AS DOUBLE) AS intensity, CAST({int(s.synthetic)} AS BIGINT) AS is_synthetic, "
    f"'{','.join(map(str, s.segments)) if s.segments else 'GLOBAL'}' AS affected_segments FROM feats" for s in whatif.CATALOG.values()), ("feats",))
def scenario_catalog(spark, d):
    return whatif.describe(T.observations(spark, d))


def predict_again(rows: DataFrame) -> DataFrame:
    """Predictions from the disturbed features."""
    return rows.withColumn("predicted", T._prediction(0.75))


cte("scenarios", " UNION ALL ".join(f"SELECT '{s}' AS scenario_id, * FROM ({scenario_sql(s)})" for s in SCENARIO_SQL), "scored")
cte("rescored", f"SELECT * REPLACE ({T._prediction_sql(0.75)} AS predicted) FROM scenarios", "scenarios")


@query("m10_scenario_benchmark", f"""SELECT *, (SELECT count(*) FROM rescored r WHERE r.scenario_id = m.scenario_id AND r.hit) AS affected_events
  FROM ({metrics_sql('rescored', 'scenario_id')}) m""", ("rescored",))
def scenario_benchmark(spark, d):
    rows = predict_again(whatif.scenario_rows(T.scored(spark, d, T.time_blocks(spark, d)))).select("scenario_id", "actual", "predicted")
    rows = materialize(rows, "rescored")  # its quantiles read the rows of all scenarios again
    metrics = evaluation.regression_metrics(rows, "actual", "predicted", ["scenario_id"], blocks=T.fits(spark, d, ABS))
    hits = whatif.describe(T.observations(spark, d)).select("scenario_id", F.col("affected_rows").alias("affected_events"))
    return rounded(metrics.join(hits, "scenario_id"), *METRICS)


# --- event records ----------------------------------------------------------------------

def _events_base(spark, d) -> DataFrame:
    return T.scored_stream(spark, d)


@query("n01_telemetry", f"""SELECT printf('EVT_%06d', idx) AS event_id, trip_id, deviceid, {s6('rolling_prev_segment_mean')} AS rolling_prev_segment_mean
  FROM scored""", ("scored",))
def telemetry(spark, d):
    rows = events.telemetry(_events_base(spark, d))
    return rounded(rows.select("event_id", "trip_id", "deviceid", "rolling_prev_segment_mean"), "rolling_prev_segment_mean")


@query("n02_evaluations", f"""SELECT printf('EVAL_%06d', idx) AS evaluation_id, predicted AS predicted_eta_sec, actual AS actual_eta_sec,
  {half_up('signed_error_sec')} AS signed_error_sec, {half_up('absolute_error_sec')} AS absolute_error_sec,
  {half_up('(absolute_error_sec / greatest(actual, 10.0::DOUBLE) * 100.0::DOUBLE)')} AS percentage_error FROM scored""", ("scored",))
def evaluations(spark, d):
    rows = _events_base(spark, d)
    out = events.evaluations(events.predictions(rows), events.outcomes(rows))
    return out.select("evaluation_id", "predicted_eta_sec", "actual_eta_sec", "signed_error_sec", "absolute_error_sec", "percentage_error")


@query("n03_record_ids", """SELECT idx, printf('EVT_%06d', idx) AS event_id, printf('PRED_%06d', idx) AS prediction_id,
  printf('OUT_%06d', idx) AS outcome_id, printf('EVAL_%06d', idx) AS evaluation_id FROM scored""", ("scored",))
def record_ids(spark, d):
    from fleetlens.ordering import with_index
    rows = with_index(T.observations(spark, d), T.TIME_ORDER, blocks=T.time_blocks(spark, d))
    names = {"EVT": "event_id", "PRED": "prediction_id", "OUT": "outcome_id", "EVAL": "evaluation_id"}
    return rows.select("idx", *[events.record_id(p, F.col("idx")).alias(n) for p, n in names.items()])


_LATEST = """SELECT deviceid, arg_max(event_id, (timestamp_utc, event_id)) AS event_id, max(timestamp_utc) AS timestamp_utc,
  arg_max(segment, (timestamp_utc, event_id)) AS segment, count(*) AS records FROM obs GROUP BY 1"""


@query("n04_latest_state", _LATEST, ("obs",))
def latest_state(spark, d):
    rows = T.observations(spark, d).select("deviceid", "event_id", "timestamp_utc", "segment")
    return events.latest_per_key(rows, "deviceid", T.TIME_ORDER).withColumn("timestamp_utc", clean_time("timestamp_utc"))


_ONLINE = ["mae_sec", "rmse_sec", "bias_sec", "median_ae_sec", "p90_error_sec", "p95_error_sec"]


@query("n05_online_metrics", f"""SELECT count(*) AS records, {s6('avg(absolute_error_sec)')} AS mae_sec,
  {s6('sqrt(avg(absolute_error_sec * absolute_error_sec))')} AS rmse_sec, {s6('avg(signed_error_sec)')} AS bias_sec,
  {s6('median(absolute_error_sec)')} AS median_ae_sec, {s6('quantile_cont(absolute_error_sec, 0.9)')} AS p90_error_sec,
  {s6('quantile_cont(absolute_error_sec, 0.95)')} AS p95_error_sec, {s6('avg(event_id % 37)')} AS avg_latency_ms FROM scored""", ("scored",))
def online_metrics(spark, d):
    """The event number stands for a latency."""
    rows = T.scored(spark, d).withColumn("latency_ms", (F.col("event_id") % 37).cast("double"))
    return rounded(events.online_metrics(rows, latency="latency_ms", blocks=T.fits(spark, d, ABS)), *_ONLINE, "avg_latency_ms")


_SNAPSHOTS = """SELECT idx, (idx + 1) // 50 AS window_index, count(*) OVER w AS sample_count, avg(absolute_error_sec) OVER w AS mae_sec,
  sqrt(avg(absolute_error_sec * absolute_error_sec) OVER w) AS rmse_sec, n FROM scored WINDOW w AS (ORDER BY idx)"""


@query("n06_metric_snapshots", f"""SELECT window_index, sample_count, {s6('mae_sec')} AS mae_sec, {s6('rmse_sec')} AS rmse_sec
  FROM ({_SNAPSHOTS}) WHERE (idx + 1) % 50 = 0""", ("scored",))
def metric_snapshots(spark, d):
    return rounded(events.metric_snapshots(T.scored(spark, d), T.TIME_ORDER, blocks=T.time_blocks(spark, d)), "mae_sec", "rmse_sec")


@query("n06_snapshot_quantiles", f"""SELECT w.window_index, {s6('median(e)')} AS median_ae_sec, {s6('quantile_cont(e, 0.9)')} AS p90_error_sec
  FROM (SELECT CAST(unnest(range(1, n // 50 + 1)) AS BIGINT) AS window_index FROM (SELECT max(n) AS n FROM scored)) w
  JOIN (SELECT idx, absolute_error_sec AS e FROM scored) s ON s.idx < w.window_index * 50 GROUP BY 1""", ("scored",))
def snapshot_quantiles(spark, d):
    out = events.snapshot_quantiles(T.stored_scored(spark, d, *T.TIME_ORDER, ABS), T.TIME_ORDER, blocks=T.time_blocks(spark, d))
    return rounded(out, "median_ae_sec", "p90_error_sec")


@query("n07_recent_predictions", """SELECT event_id, trip_id, deviceid, predicted FROM scored WHERE deviceid = 'D7'
  ORDER BY timestamp_utc DESC, event_id DESC LIMIT 50""", ("scored",))
def recent_predictions(spark, d):
    rows = T.scored(spark, d).select("event_id", "timestamp_utc", "trip_id", "deviceid", "predicted")
    return events.recent(rows, T.TIME_ORDER, 50, F.col("deviceid") == "D7").drop("timestamp_utc")


@query("n08_point_lookup", "SELECT printf('PRED_%06d', idx) AS prediction_id, predicted AS predicted_eta_sec FROM scored WHERE idx = 123", ("scored",))
def point_lookup(spark, d):
    return events.by_id(events.predictions(_events_base(spark, d)), "prediction_id", "PRED_000123")


@query("n09_event_feed", """SELECT * FROM (SELECT 'prediction' AS event_type, 'PRED_' || event_id AS record_id, timestamp_utc,
    CAST(segment AS VARCHAR) AS payload FROM obs UNION ALL SELECT 'outcome', 'OUT_' || event_id, timestamp_utc, event_type FROM obs)
  ORDER BY timestamp_utc DESC, record_id DESC LIMIT 200""", ("obs",))
def event_feed(spark, d):
    rows = T.observations(spark, d)
    shaped = {
        "prediction": rows.select(F.concat(F.lit("PRED_"), "event_id").alias("record_id"), "timestamp_utc", F.col("segment").cast("string").alias("payload")),
        "outcome": rows.select(F.concat(F.lit("OUT_"), "event_id").alias("record_id"), "timestamp_utc", F.col("event_type").alias("payload"))}
    return events.event_feed(shaped, 200).withColumn("timestamp_utc", clean_time("timestamp_utc"))


@query("n10_replay_state", f"""SELECT count(*) AS processed, count(*) FILTER (WHERE hit) AS affected_events, count(*) FILTER (WHERE NOT hit) AS unaffected_events,
  count(DISTINCT deviceid) AS active_devices, CAST(100 AS DOUBLE) AS progress_pct FROM (SELECT *, {PEAK} AS hit FROM
  (SELECT *, hour(timestamp_utc) AS hour, minute(timestamp_utc) AS minute FROM obs))""", ("obs",))
def replay_state(spark, d):
    rows = whatif.RUSH_HOUR.apply(T.observations(spark, d))
    return rounded(events.replay_state(rows, whatif.APPLIED, "deviceid"), "progress_pct")


@query("n11_vehicles_by_segment", f"SELECT deviceid, segment, count(*) OVER (PARTITION BY segment) AS vehicles_in_segment FROM ({_LATEST})", ("obs",))
def vehicles_by_segment(spark, d):
    latest = events.latest_per_key(T.observations(spark, d).select("deviceid", "event_id", "timestamp_utc", "segment"), "deviceid", T.TIME_ORDER)
    return events.vehicles_by_segment(latest, "deviceid", "segment")


@query("n12_session_merge", """SELECT trip_id, arg_max(event_id, (timestamp_utc, event_id)) AS event_id, max(timestamp_utc) AS timestamp_utc FROM obs GROUP BY 1""", ("obs",))
def session_merge(spark, d):
    rows = T.observations(spark, d).select("trip_id", "event_id", "timestamp_utc")
    old, new = rows.filter(F.col("event_id") % 2 == 0), rows.filter(F.col("event_id") % 2 == 1)
    stored = events.latest_per_key(old, "trip_id", T.TIME_ORDER).drop("records")
    return events.merge_latest(stored, new, "trip_id", T.TIME_ORDER).withColumn("timestamp_utc", clean_time("timestamp_utc"))


@query("n13_trailing_residuals", f"""SELECT event_id, {s6('avg(signed_error_sec) OVER w')} AS mean_residual, {s6('var_pop(signed_error_sec) OVER w')} AS variance_residual
  FROM scored WINDOW w AS (ORDER BY idx ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)""", ("scored",))
def trailing_residuals(spark, d):
    rows = T.scored(spark, d).select("event_id", "timestamp_utc", "signed_error_sec")
    out = events.trailing_moments(rows, T.TIME_ORDER, "signed_error_sec", span=2000, blocks=T.time_blocks(spark, d))
    return rounded(out.select("event_id", "mean_residual", "variance_residual"), "mean_residual", "variance_residual")
