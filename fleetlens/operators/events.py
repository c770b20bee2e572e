"""Telemetry, prediction, outcome and evaluation records, and the queries over them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.columns import round_to
from fleetlens.ordering import Ordered, OrderBlocks, with_index
from fleetlens.quantiles import prefix_quantiles, summarize
from fleetlens.session import materialize

GROUND_TRUTH = ["actual", "baseline_actual", "run_time_in_seconds", "eta_to_next_stop_sec"]


def record_id(prefix: str, index: Column, width: int = 6) -> Column:
    """PREFIX_000123; longer numbers keep all digits."""
    return F.format_string(f"{prefix}_%0{width}d", index.cast("long"))


def telemetry(df: DataFrame, index: str = "idx", include_ground_truth: bool = False) -> DataFrame:
    """Rows as the scorer may see them: with an event id and without outcomes."""
    out = df.withColumn("event_id", record_id("EVT", F.col(index)))
    return out if include_ground_truth else out.drop(*GROUND_TRUTH)


def predictions(df: DataFrame, index: str = "idx", extra: Sequence[str] = ()) -> DataFrame:
    return df.select(record_id("PRED", F.col(index)).alias("prediction_id"),
                     F.col("predicted").alias("predicted_eta_sec"), *extra)


def outcomes(df: DataFrame, index: str = "idx", extra: Sequence[str] = ()) -> DataFrame:
    return df.select(record_id("OUT", F.col(index)).alias("outcome_id"),
                     record_id("PRED", F.col(index)).alias("prediction_id"),
                     F.col("actual").alias("actual_eta_sec"), *extra)


def evaluations(predicted: DataFrame, observed: DataFrame) -> DataFrame:
    """Join predictions to outcomes by id; errors rounded to 2 digits."""
    joined = predicted.join(observed, "prediction_id")
    signed = F.col("actual_eta_sec") - F.col("predicted_eta_sec")
    return joined.withColumns({
        "evaluation_id": F.regexp_replace("prediction_id", "^PRED", "EVAL"),
        "signed_error_sec": round_to(signed, 2),
        "absolute_error_sec": round_to(F.abs(signed), 2),
        "percentage_error": round_to(F.abs(signed) / F.greatest(F.col("actual_eta_sec"), F.lit(10.0)) * 100.0, 2),
    })


def latest_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of every key; partial aggregation keeps one row per key and task."""
    rest = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"), F.count(F.lit(1)).alias("records"))
    return last.select(key, "r.*", "records")


def online_metrics(df: DataFrame, keys: Sequence[str] = (), latency: str | None = None,
                   blocks: dict[str, OrderBlocks] | None = None) -> DataFrame:
    """Running totals of the evaluation stream: errors, bias and latency."""
    e = F.col("absolute_error_sec")
    aggregates = {"records": F.count(F.lit(1)), "mae_sec": F.avg(e), "rmse_sec": F.sqrt(F.avg(e * e)),
                  "bias_sec": F.avg("signed_error_sec"),
                  "avg_latency_ms": F.avg(latency) if latency else F.lit(None).cast("double")}
    if not latency:
        aggregates.pop("avg_latency_ms")
    return summarize(df, list(keys), aggregates, {
        "median_ae_sec": ("absolute_error_sec", 0.5), "p90_error_sec": ("absolute_error_sec", 0.9),
        "p95_error_sec": ("absolute_error_sec", 0.95)}, blocks)


def metric_snapshots(df: DataFrame, order: Sequence[str], every: int = 50, keep: int | None = None,
                     blocks: OrderBlocks | None = None) -> DataFrame:
    """Cumulative MAE and RMSE at every ``every``-th record; of all, or of the last ``keep`` snapshots.

    Rows are first reduced to one partial per step, so the running sums are over
    1/every of the rows, again in blocks.
    """
    placed = with_index(df, list(order), "_idx", "_n", blocks)
    e = F.col("absolute_error_sec")
    steps = placed.groupBy(F.floor(F.col("_idx") / every).alias("_step")).agg(
        F.count(F.lit(1)).alias("_c"), F.sum(e).alias("_s"), F.sum(e * e).alias("_q"), F.max("_n").alias("_n"))
    complete = steps.filter(F.col("_c") == every)
    cumulative = Ordered(complete, [], ["_step"]).running_sum("_c", "sample_count").running_sum(
        "_s", "_sum").running_sum("_q", "_sq").frame()
    recent = cumulative if keep is None else cumulative.filter(F.col("_step") >= F.floor(F.col("_n") / every) - keep)
    return recent.select((F.col("_step") + 1).cast("long").alias("window_index"), "sample_count",
                         (F.col("_sum") / F.col("sample_count")).alias("mae_sec"),
                         F.sqrt(F.col("_sq") / F.col("sample_count")).alias("rmse_sec"))


def snapshot_quantiles(df: DataFrame, order: Sequence[str], every: int = 50, keep: int | None = None,
                       named: dict[str, float] | None = None, blocks: OrderBlocks | None = None) -> DataFrame:
    """Exact cumulative error quantiles at every ``every``-th record; of all, or of the last ``keep`` snapshots."""
    placed = with_index(df, list(order), "_idx", "_n", blocks)
    last = F.floor(F.col("_n") / every)
    steps = placed.filter(F.col("_idx") < last * every).select(
        "absolute_error_sec", F.floor(F.col("_idx") / every).alias("_step"),
        (F.lit(0) if keep is None else F.greatest(last - keep, F.lit(0))).cast("long").alias("_first"), (last - 1).alias("_last"))
    out = prefix_quantiles(materialize(steps, "stepped"), "absolute_error_sec", named or {"median_ae_sec": 0.5, "p90_error_sec": 0.9})
    return out.select((F.col("_step") + 1).cast("long").alias("window_index"),
                      *[c for c in out.columns if c != "_step"])


def recent(df: DataFrame, order: Sequence[str], n: int, where: Column | None = None) -> DataFrame:
    """The newest n rows that match, newest last."""
    rows = df if where is None else df.filter(where)
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def by_id(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def event_feed(sources: dict[str, DataFrame], n: int, only: str | None = None) -> DataFrame:
    """One feed of (event_type, record_id, timestamp, payload) from several tables, last n."""
    shaped = [df.select(F.lit(kind).alias("event_type"), "record_id", "timestamp_utc", "payload")
              for kind, df in sources.items() if only in (None, kind)]
    return recent(reduce(DataFrame.unionByName, shaped), ["timestamp_utc", "record_id"], n)


def replay_state(df: DataFrame, applied: str, device: str, total: int | None = None) -> DataFrame:
    """Affected and unaffected rows, progress and active devices."""
    row = df.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col(applied)).alias("affected_events"),
                 F.count_if(~F.col(applied)).alias("unaffected_events"), F.count_distinct(device).alias("active_devices"))
    whole = F.lit(total) if total is not None else F.col("processed")
    return row.withColumn("progress_pct", F.col("processed") * 100.0 / F.nullif(whole, F.lit(0)))


def vehicles_by_segment(latest: DataFrame, device: str, segment: str) -> DataFrame:
    """Vehicles with their current segment and how many share it (rows, not an unbounded list)."""
    counts = latest.groupBy(segment).agg(F.count(F.lit(1)).alias("vehicles_in_segment"))
    return latest.select(device, segment).join(counts, segment)


def merge_latest(current: DataFrame, updates: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Upsert: for each key the newest of the stored and the new row."""
    merged = latest_per_key(current.unionByName(updates), key, order)
    return merged.drop("records") if "records" not in current.columns else merged


def trailing_moments(df: DataFrame, order: Sequence[str], value: str, width: int = 500,
                     span: int = 100_000, blocks: OrderBlocks | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population variance of the last ``width`` values at every record, of all records or of each key's.

    Records are grouped in spans of consecutive positions; each span also gets the
    ``width - 1`` records before it, so no task holds more than a span. Without keys the position stays as ``idx``.
    """
    if keys:
        placed = Ordered(df, list(keys), list(order), blocks).row_number("_at").frame().withColumn("_at", F.col("_at") - 1)
    else:
        placed = with_index(df, list(order), "idx", blocks=blocks).withColumn("_at", F.col("idx"))
    own = F.floor(F.col("_at") / span)
    late = F.col("_at") % span >= span - width + 1
    spans = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.withColumn("_own", own).withColumn("_span", F.explode(spans))
    ordered = Window.partitionBy(*keys, "_span").orderBy("_at")
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value).cast("double")
    totals = spread.withColumns({"_c": F.count(x).over(running), "_s": F.coalesce(F.sum(x).over(running), F.lit(0.0)),
                                 "_q": F.coalesce(F.sum(x * x).over(running), F.lit(0.0))})
    # totals up to the record minus totals before the window: no frame is summed twice
    inside = totals.withColumns({c: F.col(c) - F.coalesce(F.lag(c, width).over(ordered), F.lit(0)) for c in ("_c", "_s", "_q")})
    n = F.nullif(F.col("_c"), F.lit(0))
    mean = F.col("_s") / n
    return inside.withColumns({
        "mean_residual": mean, "variance_residual": F.greatest(F.col("_q") / n - mean * mean, F.lit(0.0)),
    }).filter(F.col("_span") == F.col("_own")).drop("_own", "_span", "_at", "_c", "_s", "_q")
