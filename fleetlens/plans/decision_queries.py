"""Queries over retrain triggers, gates, canary stages and the model lifecycle; model jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.stats import hash_route
from fleetlens.operators import decisions, lifecycle, models
from fleetlens.operators.decisions import GateLimits, TriggerPolicy
from fleetlens.plans import testbed as T
from fleetlens.plans.evaluation_queries import ABS, METRICS, metrics_sql
from fleetlens.plans.registry import clean_time, cte, query, rounded, s6
from fleetlens.schemas import CATEGORICAL_FEATURES
from fleetlens.session import materialize

# windows of the derived data differ by a few percent, so a low ratio makes runs visible
POLICY = TriggerPolicy(degradation_ratio=1.02, alarm_threshold=3, alarm_window=2500, cooldown=1500)

cte("history", """SELECT idx // 500 AS window_index, count(*) AS samples, avg(absolute_error_sec) AS mae_sec,
  sqrt(avg(absolute_error_sec * absolute_error_sec)) AS rmse_sec FROM scored GROUP BY 1 HAVING count(*) = 500""", "scored")


@query("p01_metric_history", f"SELECT window_index, samples, {s6('mae_sec')} AS mae_sec, {s6('rmse_sec')} AS rmse_sec FROM history", ("history",))
def metric_history(spark, d):
    return rounded(decisions.metric_history(T.scored_stream(spark, d)), "mae_sec", "rmse_sec")


cte("runs", f"""SELECT min(window_index) AS first_window, max(window_index) AS last_window, count(*) AS consecutive_windows,
  min(window_index) + 1 AS trigger_window FROM (SELECT *, window_index - row_number() OVER (ORDER BY window_index) AS island FROM history
  WHERE samples >= 500 AND mae_sec / 38.77 >= {POLICY.degradation_ratio}) GROUP BY island HAVING count(*) >= 2""", "history")


@query("p02_sustained_degradation", "SELECT * FROM runs", ("runs",))
def sustained_degradation(spark, d):
    return decisions.degraded_runs(decisions.metric_history(T.scored_stream(spark, d)), POLICY)


# alarms that SQL can state as well: every record with an error above 150 s
cte("alarms", "SELECT 'ALARM_' || event_id AS event_id, idx FROM scored WHERE absolute_error_sec >= 150", "scored")
cte("alarm_points", """SELECT stream_index, count(*) AS recent_alarms, CAST(sum(CAST('0x' || substr(md5(event_id), 1, 15) AS HUGEINT)) AS VARCHAR) AS alarm_set
  FROM (SELECT *, CAST(unnest(range(CAST(ceil(idx / 500.0) AS BIGINT), (idx + 2500) // 500 + 1)) * 500 AS BIGINT) AS stream_index FROM alarms) GROUP BY 1""", "alarms")
cte("marked_points", """SELECT *, CAST(coalesce(lag(alarm_set) OVER (ORDER BY stream_index) = alarm_set, false) AS BIGINT) AS same_alarms FROM alarm_points""", "alarm_points")


def _alarms(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("absolute_error_sec") >= 150).select(F.concat(F.lit("ALARM_"), "event_id").alias("event_id"), "idx")


@query("p03_recent_alarms", "SELECT stream_index, recent_alarms, alarm_set FROM alarm_points", ("alarm_points",))
def recent_alarms(spark, d):
    return decisions.recent_alarms(_alarms(T.scored_stream(spark, d)), POLICY)


@query("p05_repeated_alarms", "SELECT stream_index, recent_alarms, alarm_set, same_alarms FROM marked_points", ("marked_points",))
def repeated_alarms(spark, d):
    return decisions.repeated_alarms(decisions.recent_alarms(_alarms(T.scored_stream(spark, d)), POLICY))


cte("points", """SELECT h.*, (window_index + 1) * 500 AS stream_index, CASE WHEN (window_index + 1) * 500 > 2000 THEN CAST(2000 AS BIGINT) END AS last_retrain_index,
  (window_index + 1) * 500 - CASE WHEN (window_index + 1) * 500 > 2000 THEN 2000 ELSE 0 END AS buffer_size FROM history h""", "history")
cte("decided", f"""SELECT p.stream_index, p.last_retrain_index, p.buffer_size,
  CAST(EXISTS (SELECT 1 FROM runs r WHERE p.window_index BETWEEN r.trigger_window AND r.last_window) AS BIGINT) AS sustained,
  coalesce(m.recent_alarms, 0) AS recent_alarms, coalesce(m.same_alarms, 0) AS same_alarms, CAST(p.window_index % 2 AS BIGINT) AS data_drift_events
  FROM points p LEFT JOIN marked_points m USING (stream_index)""", "points", "runs", "marked_points")
_BRANCHES = [("last_retrain_index IS NOT NULL AND stream_index - last_retrain_index < 1500", 0, "INFO", "cooldown active"),
             ("buffer_size < 1000", 0, "INFO", "insufficient data"), ("sustained = 1", 1, "CRITICAL", "sustained performance drift"),
             ("recent_alarms >= 3 AND same_alarms = 1", 0, "INFO", "alarms already evaluated"),
             ("recent_alarms >= 3", 1, "CRITICAL", "emergency concept drift"), ("data_drift_events > 0", 0, "WARNING", "data drift is advisory")]


def _branch(position: int, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {b[0]} THEN {b[position]!r}" for b in _BRANCHES) + f" ELSE {default} END"


def trigger_points(spark, d) -> DataFrame:
    """Evaluation points every 500 records with what the policy needs to know at each."""
    rows = T.stored_stream(spark, d, "event_id", "absolute_error_sec")
    history = materialize(decisions.metric_history(rows), "history")
    at = (F.col("window_index") + 1) * 500
    points = history.select("window_index", at.alias("stream_index"), F.when(at > 2000, F.lit(2000).cast("long")).alias("last_retrain_index"),
                            (at - F.when(at > 2000, 2000).otherwise(0)).alias("buffer_size"))
    runs = decisions.degraded_runs(history, POLICY).select(
        F.explode(F.sequence("trigger_window", "last_window")).alias("window_index"), F.lit(1).cast("long").alias("sustained"))
    recent = materialize(decisions.recent_alarms(_alarms(rows), POLICY), "recent-alarms")
    alarms = decisions.repeated_alarms(recent).drop("alarm_set")
    return points.join(runs, "window_index", "left").join(alarms, "stream_index", "left").fillna(
        0, ["sustained", "recent_alarms", "same_alarms"]).withColumn("data_drift_events", F.col("window_index") % 2).drop("window_index")


_POINT = "stream_index, last_retrain_index, buffer_size, sustained, recent_alarms, same_alarms, data_drift_events"


@query("p04_cooldown_and_data_guards", f"SELECT stream_index, CAST({_BRANCHES[0][0]} AS BIGINT) AS cooling, CAST(buffer_size < 1000 AS BIGINT) AS too_few FROM points", ("points",))
def cooldown_and_data_guards(spark, d):
    out = decisions.trigger_decisions(trigger_points(spark, d), POLICY)
    cooling = F.col("last_retrain_index").isNotNull() & (F.col("stream_index") - F.col("last_retrain_index") < POLICY.cooldown)
    return out.select("stream_index", F.coalesce(cooling, F.lit(False)).cast("long").alias("cooling"),
                      (F.col("buffer_size") < POLICY.min_new_records).cast("long").alias("too_few"))


@query("p06_trigger_decisions", f"""SELECT {_POINT}, CAST({_branch(1, '0')} AS BIGINT) AS should_retrain, {_branch(2, "'NORMAL'")} AS severity,
  {_branch(3, "'nominal'")} AS reason FROM decided""", ("decided",))
def trigger_decisions(spark, d):
    return decisions.trigger_decisions(trigger_points(spark, d), POLICY)


_PARTS = """SELECT *, CASE WHEN idx < floor(n * 0.7::DOUBLE) THEN 'train' WHEN idx < floor(n * 0.85::DOUBLE) THEN 'original' ELSE 'recent' END AS part FROM scored"""
cte("gate_rows", f"""SELECT part AS holdout, actual AS y, 'champion' AS model, predicted AS p FROM ({_PARTS}) WHERE part <> 'train'
  UNION ALL SELECT part, actual, 'candidate', candidate FROM ({_PARTS}) WHERE part <> 'train'""", "scored")
cte("gate_metrics", metrics_sql("gate_rows", "model, holdout", gate=True, y="y", p="p"), "gate_rows")
_M = "(SELECT {c} FROM gate_metrics WHERE model = '{m}' AND holdout = '{h}')"


def _metric(model: str, holdout: str, column: str) -> str:
    return _M.format(c=column, m=model, h=holdout)


def _ratio(holdout: str, column: str) -> str:
    return f"{_metric('candidate', holdout, column)} / {_metric('champion', holdout, column)}"


def holdouts(spark, d) -> dict[str, DataFrame]:
    rows = T.scored_stream(spark, d)
    a, b = F.floor(F.col("n") * F.lit(0.7)), F.floor(F.col("n") * F.lit(0.85))
    return {"original": rows.filter((F.col("idx") >= a) & (F.col("idx") < b)), "recent": rows.filter(F.col("idx") >= b)}


MODELS = {"champion": "predicted", "candidate": "candidate"}


@query("p07_holdout_metrics", "SELECT * FROM gate_metrics", ("gate_metrics",))
def holdout_metrics(spark, d):
    return rounded(decisions.holdout_metrics(holdouts(spark, d), MODELS, "actual", T.fits(spark, d, ABS)), *METRICS)


@query("p07_promotion_gate", f"""SELECT *, CAST(gate_a = 1 AND gate_b = 1 AND gate_c = 1 AS BIGINT) AS passed, concat_ws('; ',
    CASE WHEN original_mae_ratio > 1.01 THEN 'A: MAE on original holdout' END, CASE WHEN original_r2_drop > 0.01 THEN 'A: R2 on original holdout' END,
    CASE WHEN recent_mae_ratio > 1 THEN 'B: MAE on recent holdout' END, CASE WHEN original_rmse_ratio > 1.05 THEN 'C: RMSE' END,
    CASE WHEN original_p95_ratio > 1.08 THEN 'C: P95' END) AS failure_reasons FROM (
  SELECT *, CAST(original_mae_ratio <= 1.01 AND original_r2_drop <= 0.01 AS BIGINT) AS gate_a, CAST(recent_mae_ratio <= 1 AS BIGINT) AS gate_b,
    CAST(original_rmse_ratio <= 1.05 AND original_p95_ratio <= 1.08 AS BIGINT) AS gate_c FROM (SELECT {s6(_ratio('original', 'mae_sec'))} AS original_mae_ratio,
    {s6(_metric('champion', 'original', 'r2') + ' - ' + _metric('candidate', 'original', 'r2'))} AS original_r2_drop,
    {s6(_ratio('recent', 'mae_sec'))} AS recent_mae_ratio, {s6(_ratio('original', 'rmse_sec'))} AS original_rmse_ratio,
    {s6(_ratio('original', 'p95_error_sec'))} AS original_p95_ratio))""", ("gate_metrics",))
def promotion_gate(spark, d):
    metrics = rounded(decisions.holdout_metrics(holdouts(spark, d), MODELS, "actual", T.fits(spark, d, ABS)), *METRICS)
    out = decisions.promotion_gate(metrics, GateLimits())
    return rounded(out, "original_mae_ratio", "original_r2_drop", "recent_mae_ratio", "original_rmse_ratio", "original_p95_ratio")


@query("p08_shadow_check", f"""SELECT *, concat_ws('; ', CASE WHEN non_positive > 0 THEN 'non-positive predictions' END, CASE WHEN excessive > 0 THEN 'excessive predictions' END,
    CASE WHEN mae_ratio > 1.02 THEN 'MAE ratio' END) AS failure_reasons, CAST(non_positive = 0 AND excessive = 0 AND mae_ratio <= 1.02 AS BIGINT) AS passed FROM (
  SELECT count(*) AS sample_count, {s6('avg(abs(actual - predicted))')} AS champion_mae, {s6('avg(abs(actual - candidate))')} AS candidate_mae,
    CAST(0 AS BIGINT) AS exceptions, count(*) FILTER (WHERE candidate <= 0) AS non_positive, count(*) FILTER (WHERE candidate > 3600) AS excessive,
    {s6('avg(abs(actual - candidate)) / avg(abs(actual - predicted))')} AS mae_ratio FROM scored)""", ("scored",))
def shadow_check(spark, d):
    return rounded(decisions.shadow_check(T.scored_stream(spark, d), "actual", "predicted", "candidate"), "champion_mae", "candidate_mae", "mae_ratio")


_ROUTE = ("((CAST('0x' || substr(md5(trip_id), 1, 16) AS HUGEINT) % 100) * 16 + CAST('0x' || substr(md5(trip_id), 17, 16) AS HUGEINT) % 100) % 100")


@query("p09_canary_route", f"SELECT event_id, CAST({_ROUTE} < 10 AS BIGINT) AS ten, CAST({_ROUTE} < 50 AS BIGINT) AS fifty, CAST(1 AS BIGINT) AS everyone, CAST(0 AS BIGINT) AS nobody FROM obs", ("obs",))
def canary_route(spark, d):
    shares = {"ten": 10, "fifty": 50, "everyone": 100, "nobody": 0}
    return T.observations(spark, d).select("event_id", *[hash_route(F.col("trip_id"), p).cast("long").alias(n) for n, p in shares.items()])


_CANARY = ["champion_mae", "candidate_mae", "champion_rmse", "candidate_rmse", "champion_p95", "candidate_p95", "mae_ratio"]


@query("p10_canary_stage", f"""SELECT *, concat_ws('; ', CASE WHEN selected_records < 15 THEN 'too few samples' END, CASE WHEN mae_ratio > 1.05 THEN 'MAE ratio' END) AS failure_reasons,
  CAST(selected_records >= 15 AND mae_ratio <= 1.05 AS BIGINT) AS passed FROM (SELECT count(*) AS selected_records, count(DISTINCT trip_id) AS unique_trips,
    min(timestamp_utc) AS time_range_start, max(timestamp_utc) AS time_range_end, CAST(0 AS BIGINT) AS unmatched_records, (SELECT count(*) FROM scored) AS total_records,
    CAST(50 AS BIGINT) AS canary_percentage, {s6('avg(abs(actual - predicted))')} AS champion_mae, {s6('avg(abs(actual - candidate))')} AS candidate_mae,
    {s6('sqrt(avg(pow(actual - predicted, 2)))')} AS champion_rmse, {s6('sqrt(avg(pow(actual - candidate, 2)))')} AS candidate_rmse,
    {s6('quantile_cont(abs(actual - predicted), 0.95)')} AS champion_p95, {s6('quantile_cont(abs(actual - candidate), 0.95)')} AS candidate_p95,
    {s6('avg(abs(actual - candidate)) / avg(abs(actual - predicted))')} AS mae_ratio FROM scored WHERE {_ROUTE} < 50)""", ("scored",))
def canary_stage(spark, d):
    out = decisions.canary_stage(T.scored_stream(spark, d), 50, "actual", "predicted", "candidate",
                                 blocks=T.fits(spark, d, "champion_error", "candidate_error"))
    return rounded(out.withColumns({c: clean_time(c) for c in ("time_range_start", "time_range_end")}), *_CANARY)


_WINDOWS = "SELECT *, idx // 500 AS window_index FROM scored"


@query("p08_shadow_windows", f"""SELECT *, concat_ws('; ', CASE WHEN non_positive > 0 THEN 'non-positive predictions' END, CASE WHEN excessive > 0 THEN 'excessive predictions' END,
    CASE WHEN mae_ratio > 1.02 THEN 'MAE ratio' END) AS failure_reasons, CAST(non_positive = 0 AND excessive = 0 AND mae_ratio <= 1.02 AS BIGINT) AS passed FROM (
  SELECT window_index, count(*) AS sample_count, {s6('avg(abs(actual - predicted))')} AS champion_mae, {s6('avg(abs(actual - candidate))')} AS candidate_mae,
    CAST(0 AS BIGINT) AS exceptions, count(*) FILTER (WHERE candidate <= 0) AS non_positive, count(*) FILTER (WHERE candidate > 3600) AS excessive,
    {s6('avg(abs(actual - candidate)) / avg(abs(actual - predicted))')} AS mae_ratio FROM ({_WINDOWS}) GROUP BY 1)""", ("scored",))
def shadow_windows(spark, d):
    out = decisions.shadow_check(T.scored_stream(spark, d), "actual", "predicted", "candidate", window=500)
    return rounded(out, "champion_mae", "candidate_mae", "mae_ratio")


@query("p10_canary_windows", f"""SELECT *, concat_ws('; ', CASE WHEN selected_records = 0 THEN 'record ids differ' END, CASE WHEN selected_records < 15 THEN 'too few samples' END, CASE WHEN mae_ratio > 1.05 THEN 'MAE ratio' END) AS failure_reasons,
  CAST(selected_records >= 15 AND mae_ratio <= 1.05 AS BIGINT) AS passed FROM (SELECT window_index, total_records, coalesce(selected_records, 0) AS selected_records, coalesce(unique_trips, 0) AS unique_trips,
    CAST(10 AS BIGINT) AS canary_percentage, {s6('champion_mae')} AS champion_mae, {s6('candidate_mae')} AS candidate_mae, {s6('coalesce(candidate_mae / champion_mae, 1)')} AS mae_ratio
  FROM (SELECT window_index, count(*) AS total_records FROM ({_WINDOWS}) GROUP BY 1) LEFT JOIN (SELECT window_index, count(*) AS selected_records, count(DISTINCT trip_id) AS unique_trips,
    avg(abs(actual - predicted)) AS champion_mae, avg(abs(actual - candidate)) AS candidate_mae FROM ({_WINDOWS}) WHERE {_ROUTE} < 10 GROUP BY 1) USING (window_index))""", ("scored",))
def canary_windows(spark, d):
    out = decisions.canary_stage(T.scored_stream(spark, d), 10, "actual", "predicted", "candidate", blocks=T.fits(spark, d, "champion_error", "candidate_error"), window=500)
    return rounded(out.select("window_index", "total_records", "selected_records", "unique_trips", "canary_percentage", "champion_mae", "candidate_mae", "mae_ratio", "failure_reasons", "passed"),
                   "champion_mae", "candidate_mae", "mae_ratio")


# The event number stands for a latency; some event types count as exceptions.
cte("watched", f"""SELECT *, CAST(rollback_reason <> '' AS BIGINT) AS rollback_triggered FROM (
  SELECT *, concat_ws('; ', CASE WHEN mae_ratio > 1.05 THEN 'MAE' END, CASE WHEN avg_latency_ms > 18.2 THEN 'latency' END, CASE WHEN exceptions > 0 THEN 'exceptions' END) AS rollback_reason FROM (
    SELECT window_index, count(*) AS samples, {s6('avg(absolute_error_sec)')} AS observed_mae, {s6('avg(event_id % 37)')} AS avg_latency_ms,
      count(*) FILTER (WHERE event_type = 'error' AND event_id % 101 = 0) AS exceptions, {s6('avg(absolute_error_sec) / 30')} AS mae_ratio FROM ({_WINDOWS}) GROUP BY 1))""", "scored")


def _watched(spark, d) -> DataFrame:
    rows = T.scored_stream(spark, d)
    return rows.select("idx", "absolute_error_sec", (F.col("event_id") % 37).cast("double").alias("latency_ms"),
                       ((F.col("event_type") == "error") & (F.col("event_id") % 101 == 0)).alias("failed"))


_LIMITS = {"baseline_mae": 30.0, "max_ratio": 1.05, "max_latency_ms": 18.2, "latency": "latency_ms", "exception": "failed"}


@query("p11_watchdog_windows", "SELECT * FROM watched", ("watched",))
def watchdog_windows(spark, d):
    return rounded(decisions.watchdog_windows(_watched(spark, d), **_LIMITS), "observed_mae", "mae_ratio", "avg_latency_ms")


@query("p11_watchdog", """SELECT watched.*, (SELECT count(*) FROM watched) AS windows, (SELECT CAST(sum(rollback_triggered) AS BIGINT) FROM watched) AS tripped_windows FROM watched
  ORDER BY rollback_triggered DESC, CASE WHEN rollback_triggered = 1 THEN window_index ELSE -window_index END LIMIT 1""", ("watched",))
def watchdog(spark, d):
    return rounded(decisions.watchdog(_watched(spark, d), **_LIMITS), "observed_mae", "mae_ratio", "avg_latency_ms")


# --- lifecycle --------------------------------------------------------------------------

LOG_ORDER = ["ts", "event_id"]
_LEGAL = " OR ".join(f"(from_status = '{a}' AND to_status IN ({', '.join(repr(b) for b in bs)}))" for a, bs in lifecycle.ALLOWED.items() if bs)
cte("checked", f"""SELECT *, CAST(CASE WHEN from_status IS NULL THEN to_status = 'CANDIDATE' ELSE {_LEGAL} END AS BIGINT) AS is_legal FROM (
  SELECT *, lag(to_status) OVER w AS from_status, row_number() OVER w AS step FROM log WINDOW w AS (PARTITION BY model_id ORDER BY ts, event_id))""", "log")
cte("status", """SELECT model_id, arg_max(to_status, (ts, event_id)) AS status, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id,
  count(*) AS transitions FROM log GROUP BY 1""", "log")


@query("q01_transition_check", "SELECT model_id, event_id, from_status, to_status, is_legal FROM checked", ("checked",))
def transition_check(spark, d):
    return lifecycle.check_transitions(T.transitions(spark, d), LOG_ORDER).select("model_id", "event_id", "from_status", "to_status", "is_legal")


@query("q02_current_status", "SELECT * FROM status", ("status",))
def current_status(spark, d):
    return lifecycle.current_status(T.transitions(spark, d), LOG_ORDER)


@query("q02_history", "SELECT model_id, step, from_status, to_status, ts FROM checked", ("checked",))
def history(spark, d):
    out = lifecycle.check_transitions(T.transitions(spark, d), LOG_ORDER)
    return out.select("model_id", F.col("step").cast("long"), "from_status", "to_status", "ts")


@query("q03_production_model", """SELECT model_id, status FROM status WHERE status = 'PRODUCTION' ORDER BY CASE WHEN model_id = 'M7' THEN 0 ELSE 1 END, model_id LIMIT 1""", ("status",))
def production_model(spark, d):
    return lifecycle.production_model(lifecycle.current_status(T.transitions(spark, d), LOG_ORDER), "M7").select("model_id", "status")


@query("q04_production_invariant", """SELECT event_id, CAST(sum(change) OVER (ORDER BY ts, event_id) AS BIGINT) AS in_production FROM (SELECT *,
  CASE WHEN to_status = 'PRODUCTION' THEN 1 ELSE 0 END - CASE WHEN from_status = 'PRODUCTION' THEN 1 ELSE 0 END AS change FROM checked)
  QUALIFY sum(change) OVER (ORDER BY ts, event_id) <> 1""", ("checked",))
def production_invariant(spark, d):
    checked = lifecycle.check_transitions(T.transitions(spark, d), LOG_ORDER)
    return lifecycle.production_counts(checked, LOG_ORDER).filter(F.col("in_production") != 1).select("event_id", "in_production")


@query("q05_rollback_targets", """SELECT s.model_id, coalesce(p.parent_model_id, 'champion_v1') AS rollback_to, t.status AS target_status
  FROM status s LEFT JOIN parents p USING (model_id) LEFT JOIN status t ON t.model_id = coalesce(p.parent_model_id, 'champion_v1')
  WHERE s.status = 'PRODUCTION'""", ("status", "parents"))
def rollback_targets(spark, d):
    return lifecycle.rollback_targets(lifecycle.current_status(T.transitions(spark, d), LOG_ORDER), T.parents(spark, d), "champion_v1")


@query("q06_latest_non_production", "SELECT model_id, status FROM status WHERE status <> 'PRODUCTION' ORDER BY ts DESC, event_id DESC LIMIT 1", ("status",))
def latest_non_production(spark, d):
    return lifecycle.latest_non_production(lifecycle.current_status(T.transitions(spark, d), LOG_ORDER), LOG_ORDER).select("model_id", "status")


@query("q07_transition_audit", """SELECT to_status, count(*) FILTER (WHERE is_legal = 1) AS accepted, count(*) FILTER (WHERE is_legal = 0) AS rejected
  FROM checked GROUP BY 1""", ("checked",))
def transition_audit(spark, d):
    return lifecycle.transition_audit(lifecycle.check_transitions(T.transitions(spark, d), LOG_ORDER))


# --- models -----------------------------------------------------------------------------

LABEL = "run_time_in_seconds"


def _parts(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = materialize(T.split_rows(spark, d, T.feature_table(spark, d)).withColumn(
        "label", F.col(LABEL)), "features")
    return rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "validation")


ALGORITHMS = ["random_forest", "boosted_trees", "ridge"]


def _fitted(train: DataFrame, validation: DataFrame, algorithm: str):
    """A model with full settings; boosting stops early by the validation rows."""
    if algorithm != "boosted_trees":
        return models.fit(train, algorithm, "label")
    both = train.withColumn("is_validation", F.lit(False)).unionByName(validation.withColumn("is_validation", F.lit(True)))
    return models.fit(both, algorithm, "label", validation="is_validation")


def _scored_by(spark, d, algorithm: str) -> DataFrame:
    train, validation = _parts(spark, d)
    model = _fitted(train, validation, algorithm)
    return models.score(model, validation, f"model_{algorithm}", "v1")


@query("j01_category_codes", " UNION ALL ".join(f"""SELECT DISTINCT '{c}' AS feature, CAST({c} AS VARCHAR) AS category,
  CAST(dense_rank() OVER (ORDER BY CAST({c} AS VARCHAR)) - 1 AS DOUBLE) AS code FROM split_obs WHERE split = 'train'""" for c in CATEGORICAL_FEATURES), ("split_obs",))
def category_codes(spark, d):
    """Codes of all category columns; the fit is one pass over the rows."""
    from pyspark.ml import Pipeline
    rows = models.coerce(T.split_rows(spark, d).filter(F.col("split") == "train"), CATEGORICAL_FEATURES, [])
    coded = Pipeline(stages=models.tree_stages(CATEGORICAL_FEATURES, [])[:1]).fit(rows).transform(rows)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("category"), F.col(f"{c}_code").alias("code")) for c in CATEGORICAL_FEATURES]))
    return coded.select(pairs.alias("p")).select("p.*").distinct()


@query("j02_linear_preparation", f"SELECT count(*) AS records, CAST(round(avg(v), 6) AS DOUBLE) + 0.0 AS mean, {s6('stddev_pop(v)')} AS deviation FROM ("
       "SELECT (length - avg(length) OVER ()) / stddev_pop(length) OVER () AS v FROM split_obs WHERE split = 'train')", ("split_obs",))
def linear_preparation(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    rows = models.coerce(T.split_rows(spark, d).filter(F.col("split") == "train"), ["deviceid"], ["length"])
    prepared = Pipeline(stages=models.linear_stages(rows.count(), ["deviceid"], ["length"])).fit(rows).transform(rows)
    v = vector_to_array("standard")[0]
    out = prepared.select(v.alias("v")).agg(F.count("v").alias("records"), (F.round(F.avg("v"), 6) + F.lit(0.0)).alias("mean"), F.stddev_pop("v").alias("deviation"))
    return rounded(out.withColumn("mean", F.abs("mean")), "deviation")


@query("j04_median_baseline", f"""SELECT event_id, {s6('(SELECT median(run_time_in_seconds) FROM split_obs WHERE split = ' + chr(39) + 'train' + chr(39) + ')')} AS prediction
  FROM split_obs WHERE split = 'validation'""", ("split_obs",))
def median_baseline(spark, d):
    rows = T.split_rows(spark, d)
    out = models.median_prediction(rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "validation"), LABEL)
    return rounded(out.select("event_id", "prediction"), "prediction")


def _model_query(name: str, algorithm: str):
    @query(name)
    def run(spark, d):
        return rounded(_scored_by(spark, d, algorithm).select("event_id", "label", "predicted"), "predicted")
    return run


_model_query("j05_ridge", "ridge")
_model_query("j06_random_forest", "random_forest")
_model_query("j07_boosted_trees", "boosted_trees")


@query("j08_leaderboard")
def leaderboard(spark, d):
    train, validation = _parts(spark, d)
    scored = {a: models.score(_fitted(train, validation, a), validation) for a in ALGORITHMS}
    scored["median"] = models.median_prediction(train, validation, "label").withColumnRenamed("prediction", "predicted")
    return rounded(models.leaderboard(scored, "label", "predicted"), *METRICS)


@query("j09_performance_gate", f"""SELECT samples, mae_sec, r2, p95_error_sec, concat_ws('; ', CASE WHEN mae_sec > 48 THEN 'MAE' END, CASE WHEN r2 < 0.65 THEN 'R2' END,
  CASE WHEN p95_error_sec > 160 THEN 'P95' END) AS failure_reasons, CAST(mae_sec <= 48 AND r2 >= 0.65 AND p95_error_sec <= 160 AS BIGINT) AS passed
  FROM ({metrics_sql('preds')})""", ("preds",))
def performance_gate(spark, d):
    from fleetlens.operators.evaluation import regression_metrics
    out = models.performance_gate(regression_metrics(T.scored(spark, d), "actual", "predicted", blocks=T.fits(spark, d, ABS)))
    return rounded(out.select("samples", "mae_sec", "r2", "p95_error_sec", "failure_reasons", "passed"), "mae_sec", "r2", "p95_error_sec")


@query("j10_importances")
def importances(spark, d):
    train, validation = _parts(spark, d)
    return rounded(models.importances(_fitted(train, validation, "random_forest"), spark), "importance")


@query("j11_candidate_fit")
def candidate_fit(spark, d):
    train, validation = _parts(spark, d)
    model = _fitted(train, validation, "boosted_trees")
    return rounded(models.score(model, validation, "candidate", "v1.1").select("event_id", "predicted", "predicted_model_version"), "predicted")


@query("k01_score_table")
def score_table(spark, d):
    return rounded(_scored_by(spark, d, "ridge").select("event_id", "raw_predicted", "predicted", "predicted_model_id"), "raw_predicted")


@query("k03_dual_scoring")
def dual_scoring(spark, d):
    train, validation = _parts(spark, d)
    champion = _fitted(train, validation, "ridge")
    candidate = _fitted(train, validation, "boosted_trees")
    return models.dual_score(champion, candidate, validation).select("event_id", "label", "champion", "candidate")
