"""Streaming forms; each equals its batch form on the same rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetlens.operators.drift_windows import DriftConfig
from fleetlens.operators.events import latest_per_key, merge_latest
from fleetlens.operators.whatif import Scenario
from fleetlens.session import scratch_path


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there into Parquet and stop."""
    query = (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def collect_stream(df: DataFrame, label: str) -> DataFrame:
    """Drain an append-mode stream into the shared folder and read the result."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    run_available(df, path, scratch_path(spark, f"{label}-checkpoint"))
    return spark.read.schema(df.schema).parquet(path)


def collect_updates(df: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    """Drain an update-mode stream: every batch is written, the newest row per key is read."""
    spark = df.sparkSession
    path = scratch_path(spark, label)

    def keep(batch: DataFrame, number: int) -> None:
        # an overwrite of the batch's own folder keeps a retried batch exact
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (df.writeStream.foreachBatch(keep).option("checkpointLocation", scratch_path(spark, f"{label}-checkpoint"))
             .outputMode("update").trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.parquet(path)
    names = [c for c in df.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("r"))
    return last.select(*keys, "r.*")


def disturb(stream: DataFrame, scenario: Scenario) -> DataFrame:
    """What-ifs are row-wise, so they apply to a stream as they are."""
    return scenario.apply(stream)


def resolve_outcomes(predicted: DataFrame, observed: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Stream-stream join of predictions and outcomes on id within a time bound."""
    p = predicted.withWatermark("predicted_at", delay)
    o = observed.withColumnRenamed("prediction_id", "_pid").withWatermark("observed_at", delay)
    bound = (F.col("observed_at") >= F.col("predicted_at")) & (
        F.col("observed_at") <= F.col("predicted_at") + F.expr(f"INTERVAL {delay}"))
    return p.join(o, (F.col("prediction_id") == F.col("_pid")) & bound).drop("_pid")


def settle_outcomes(predicted: DataFrame, observed: DataFrame, folder: str, checkpoint: str, key: str = "prediction_id", predicted_at: str = "predicted_at",
                    observed_at: str = "observed_at", delay: str = "1 hour", late: str = "1 hour") -> StreamingQuery:
    """Every prediction and every outcome leaves exactly once: resolved, unresolved or orphaned; read them with ``settled_outcomes``.

    An outcome resolves the prediction of its id if it was observed within ``delay`` after it. What found no partner waits in a table
    of open rows, and leaves once the newest time seen is more than ``late`` beyond its last chance: a prediction as UNRESOLVED, an
    outcome as ORPHAN. Unlike with a join by watermark, an outcome that comes too late is kept, as an orphan. Open rows are those of the last
    ``delay`` + ``late``, so a batch's work doesn't grow with the history.

    Batch n reads the open rows that batch n - 1 wrote and writes its own to the other of two folders, and its results to a folder of
    its number, so a repeated batch gives the same files. Of several fitting outcomes the earliest counts and the others become orphans;
    predictions that share an id share its outcome if they are open together; rows without an id or a time find no partner, and those
    without a time leave at once.
    """
    p, o = F.struct(*predicted.columns).alias("prediction"), F.struct(*observed.columns).alias("outcome")
    left = predicted.select(F.col(key).alias("id"), F.col(predicted_at).cast("timestamp").alias("at"), p)
    right = observed.select(F.col(key).alias("id"), F.col(observed_at).cast("timestamp").alias("at"), o)
    both = left.unionByName(right, allowMissingColumns=True)
    wait, grace = F.expr(f"INTERVAL {delay}"), F.expr(f"INTERVAL {late}")

    def step(batch: DataFrame, number: int) -> None:
        spark, mine, other = batch.sparkSession, number % 2, (number + 1) % 2
        rows, clocks = batch, batch.agg(F.max("at").alias("clock"))
        if number:
            rows = rows.unionByName(spark.read.schema(both.schema).parquet(f"{folder}/open/{other}"))
            clocks = clocks.unionByName(spark.read.parquet(f"{folder}/clock/{other}").select("clock"))
        clocks.agg(F.max("clock").alias("clock")).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/clock/{mine}")
        clock = F.lit(spark.read.parquet(f"{folder}/clock/{mine}").first()["clock"]).cast("timestamp")
        made, seen = rows.filter(F.col("prediction").isNotNull()), rows.filter(F.col("outcome").isNotNull())
        first = made.groupBy("id").agg(F.min("at").alias("_from"))
        fitting = seen.join(first, "id").filter(F.col("at").between(F.col("_from"), F.col("_from") + wait))
        taken = fitting.groupBy("id").agg(F.min("at").alias("_taken"), F.min(F.struct("at", "outcome"))["outcome"].alias("_outcome"))

        def state(last: Column, gone: str) -> Column:
            return F.when(F.coalesce(last + grace < clock, F.lit(True)), gone).otherwise("OPEN")

        kept = [*both.columns, "status"]
        predictions = made.join(taken, "id", "left").withColumn("outcome", F.col("_outcome")).withColumn(
            "status", F.when(F.col("_taken").isNotNull(), "RESOLVED").otherwise(state(F.col("at") + wait, "UNRESOLVED"))).select(*kept)
        same = F.col("outcome").eqNullSafe(F.col("_outcome"))
        outcomes = seen.join(taken, "id", "left").filter(~F.coalesce(same & F.col("_taken").isNotNull(), F.lit(False))).withColumn(
            "status", state(F.col("at"), "ORPHAN")).select(*kept)
        judged = predictions.unionByName(outcomes).persist()
        judged.filter("status != 'OPEN'").write.mode("overwrite").parquet(f"{folder}/settled/batch={number}")
        judged.filter("status = 'OPEN'").drop("status").write.mode("overwrite").parquet(f"{folder}/open/{mine}")
        judged.unpersist()

    return both.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """(id, at, prediction, outcome, status) of a stopped ``settle_outcomes``; what still waits is OPEN."""
    last = max((spark.read.parquet(f"{folder}/clock/{side}").first()["batch"], side) for side in (0, 1) if _written(spark, f"{folder}/clock/{side}"))[1]
    settled = spark.read.parquet(f"{folder}/settled").drop("batch")
    return settled.unionByName(spark.read.parquet(f"{folder}/open/{last}").withColumn("status", F.lit("OPEN")))


def _written(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def latest_state(stream: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Newest row per key; one row of state per key."""
    return latest_per_key(stream, key, order)


def running_metrics(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Error totals per key.  Percentiles are approximate: exact ones would keep every value in state."""
    e = F.col("absolute_error_sec")
    return stream.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"), F.avg(e).alias("mae_sec"), F.sqrt(F.avg(e * e)).alias("rmse_sec"),
        F.avg("signed_error_sec").alias("bias_sec"), F.percentile_approx(e, 0.5, 10_000).alias("median_ae_sec"),
        F.percentile_approx(e, 0.9, 10_000).alias("p90_error_sec"))


LONGS = ["window_id", "window_start_idx", "window_end_idx", "sample_count"]
DOUBLES = ["mae", "rmse", "mean_signed_error"]
WINDOW_FIELDS = [*[T.StructField(n, T.LongType()) for n in LONGS], *[T.StructField(n, T.DoubleType()) for n in DOUBLES],
                 T.StructField("severity", T.StringType())]


def count_windows(stream: DataFrame, keys: Sequence[str], order: Sequence[str], error: str,
                  cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Full count windows of each key as they complete; at most one window of values is state.

    The tail window belongs to the end of a stream and is a batch matter.
    """
    keys, order = list(keys), list(order)
    schema = T.StructType([*[stream.schema[k] for k in keys], *WINDOW_FIELDS])
    state_schema = T.StructType([T.StructField("start", T.LongType()), T.StructField("window_id", T.LongType()),
                                 T.StructField("errors", T.ArrayType(T.DoubleType()))])

    def step(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        start, number, kept = held.get if held.exists else (0, 0, [])
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        errors = np.concatenate([np.asarray(kept, dtype=float), rows[error].to_numpy(dtype=float)])
        out = []
        while len(errors) >= cfg.window_size:
            e = errors[: cfg.window_size]
            mae, rmse = float(np.abs(e).mean()), float(np.sqrt((e * e).mean()))
            mae_ratio, rmse_ratio = mae / cfg.reference_mae, rmse / cfg.reference_rmse
            worst = max(mae_ratio, rmse_ratio)
            severity = ("CRITICAL" if worst >= cfg.perf_critical else "HIGH" if worst >= cfg.perf_drift
                        else "MEDIUM" if mae_ratio >= cfg.perf_warning else "NONE")
            out.append((*key, number, start, start + cfg.window_size - 1, cfg.window_size, mae, rmse, float(e.mean()), severity))
            errors, start, number = errors[cfg.step_size:], start + cfg.step_size, number + 1
        held.update((start, number, errors.tolist()))
        yield pd.DataFrame(out, columns=schema.names)

    return stream.groupBy(*keys).applyInPandasWithState(step, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def upsert_sessions(stream: DataFrame, key: str, order: Sequence[str], folder: str, checkpoint: str) -> StreamingQuery:
    """Newest row per session after every batch: version n is built from version n - 1.

    A retried batch rewrites the same version from the same predecessor, so the result does not change.
    """
    def merge(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = batch
        if number > 0:
            rows = merge_latest(spark.read.schema(batch.schema).parquet(f"{folder}/version={number - 1}"), batch, key, order)
        else:
            rows = latest_per_key(batch, key, order).drop("records")
        rows.select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
