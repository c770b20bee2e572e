"""Count-based sliding windows and the error statistics of each window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.columns import melt
from fleetlens.ordering import OrderBlocks, with_index

SEVERITIES = ["NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]


@dataclass(frozen=True)
class DriftConfig:
    """Window sizes and thresholds (fixed values unless overridden)."""

    window_size: int = 500
    step_size: int = 250
    min_window_size: int = 100
    psi_warning: float = 0.15
    psi_drift: float = 0.25
    psi_critical: float = 0.45
    ks_alpha: float = 0.05
    ks_critical: float = 0.18
    categorical_low: float = 0.60
    categorical_threshold: float = 0.25
    perf_warning: float = 1.30
    perf_drift: float = 1.60
    perf_critical: float = 2.20
    ph_delta: float = 0.25
    ph_lambda: float = 80.0
    ph_alpha: float = 0.999
    adwin_delta: float = 0.001
    reference_mae: float = 38.77
    reference_rmse: float = 60.83


def severity_rank(severity: Column) -> Column:
    """Position of a severity name, for max()."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def severity_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), (rank - 1).cast("int"))


def _full_windows(n: Column, cfg: DriftConfig) -> Column:
    return F.when(n >= cfg.window_size, F.floor((n - cfg.window_size) / cfg.step_size) + 1).otherwise(0)


def window_numbers(idx: Column, n: Column, cfg: DriftConfig = DriftConfig()) -> Column:
    """Numbers of the windows that hold a record.

    Window w covers positions [w * step, w * step + size).  All full windows
    count; the first incomplete one is the tail and counts if it is long enough.
    """
    full = _full_windows(n, cfg)
    tail_ok = (n - full * cfg.step_size) >= cfg.min_window_size
    last = F.when(tail_ok, full).otherwise(full - 1)
    first = F.greatest(F.floor((idx - cfg.window_size) / cfg.step_size) + 1, F.lit(0))
    top = F.least(F.floor(idx / cfg.step_size), last)
    return F.when(first <= top, F.sequence(first, top)).otherwise(F.array().cast("array<bigint>"))


def indexed(df: DataFrame, order: Sequence[str], blocks: OrderBlocks | None = None) -> DataFrame:
    """Rows with their stream position ``idx`` and the stream length ``n``."""
    return with_index(df, list(order), "idx", "n", blocks)


def sliding_windows(df: DataFrame, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Indexed rows repeated once per window that holds them (column ``window_id``, from 0)."""
    return df.withColumn("window_id", F.explode(window_numbers(F.col("idx"), F.col("n"), cfg)))


def pane_counts(df: DataFrame, keys: Sequence[str], features: Sequence[str], cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Counts per (keys, pane, feature, value): everything the feature statistics need, in one shuffle.

    A pane is a run of records that always share their windows, so windows are sums of panes.
    """
    unit = gcd(cfg.window_size, cfg.step_size)
    ids = [*keys, "n", "pane"]
    rows = df.withColumn("pane", F.floor(F.col("idx") / unit).cast("long"))
    long = melt(rows, ids, list(features)).filter(F.col("value").isNotNull())
    return long.groupBy(*ids, "feature", "value").agg(F.count(F.lit(1)).alias("records"))


def category_pane_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str], cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Counts per (keys, pane, feature, category); records without a category have a null one."""
    ids = [*keys, "n", "pane"]
    text = df.withColumn("pane", F.floor(F.col("idx") / gcd(cfg.window_size, cfg.step_size)).cast("long")).select(
        *ids, *[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot(ids, list(columns), "feature", "category").groupBy(*ids, "feature", "category").agg(F.count(F.lit(1)).alias("records"))


def panes_to_windows(panes: DataFrame, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Repeat pane aggregates for the windows that hold the pane."""
    unit = gcd(cfg.window_size, cfg.step_size)
    ids = window_numbers(F.col("pane") * unit, F.col("n"), cfg)
    return panes.withColumn("window_id", F.explode(ids)).drop("pane", "n")


def window_bounds(windowed: DataFrame, keys: Sequence[str] = (), ts: str | None = None) -> DataFrame:
    extra = [F.max_by(ts, "idx").alias("window_end_time")] if ts else []
    return windowed.groupBy(*keys, "window_id").agg(
        F.min("idx").alias("window_start_idx"), F.max("idx").alias("window_end_idx"),
        F.count(F.lit(1)).alias("sample_count"), *extra)


def pane_bounds(df: DataFrame, keys: Sequence[str] = (), cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """``window_bounds`` of indexed rows by way of their panes: rows are not repeated for their windows."""
    unit = gcd(cfg.window_size, cfg.step_size)
    panes = df.groupBy(*keys, "n", F.floor(F.col("idx") / unit).cast("long").alias("pane")).agg(
        F.min("idx").alias("_low"), F.max("idx").alias("_high"), F.count(F.lit(1)).alias("_c"))
    return panes_to_windows(panes, cfg).groupBy(*keys, "window_id").agg(
        F.min("_low").alias("window_start_idx"), F.max("_high").alias("window_end_idx"), F.sum("_c").alias("sample_count"))


def performance_windows(df: DataFrame, keys: Sequence[str] = (), cfg: DriftConfig = DriftConfig(),
                        reference_mae: float | None = None, reference_rmse: float | None = None) -> DataFrame:
    """Error statistics, degradation ratios and severity per window.

    ``df`` is indexed and has signed and absolute errors.  The tail window is
    judged on the last ``window_size`` records of the stream.
    """
    ref_mae = reference_mae if reference_mae is not None else cfg.reference_mae
    ref_rmse = reference_rmse if reference_rmse is not None else cfg.reference_rmse
    full = _full_windows(F.col("n"), cfg)
    in_tail = (F.col("idx") >= F.col("n") - cfg.window_size) & (
        (F.col("n") - full * cfg.step_size) >= cfg.min_window_size)
    own = F.filter(window_numbers(F.col("idx"), F.col("n"), cfg), lambda w: w < full)
    ids = F.when(in_tail, F.concat(own, F.array(full.cast("long")))).otherwise(own)
    rows = df.withColumn("window_id", F.explode(ids))
    a, s = F.col("absolute_error_sec"), F.col("signed_error_sec")
    q = F.percentile(a, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    stats = rows.groupBy(*keys, "window_id").agg(
        F.min("idx").alias("window_start_idx"), F.max("idx").alias("window_end_idx"),
        F.count(F.lit(1)).alias("sample_count"), F.avg(a).alias("mae"), F.sqrt(F.avg(s * s)).alias("rmse"),
        q.alias("_q"), F.avg(s).alias("mean_signed_error"), F.var_pop(s).alias("error_variance"),
        F.avg(F.when(s > 0, 1.0).otherwise(0.0)).alias("underestimation_rate"))
    out = stats.withColumns({
        "median_ae": F.col("_q")[0], "p90_error": F.col("_q")[1], "p95_error": F.col("_q")[2],
        "mae_ratio": F.col("mae") / max(ref_mae, 1e-3), "rmse_ratio": F.col("rmse") / max(ref_rmse, 1e-3),
    }).drop("_q")
    worst = F.greatest("mae_ratio", "rmse_ratio")
    severity = (F.when(worst >= cfg.perf_critical, "CRITICAL").when(worst >= cfg.perf_drift, "HIGH")
                .when(F.col("mae_ratio") >= cfg.perf_warning, "MEDIUM").otherwise("NONE"))
    return out.withColumn("severity", severity).withColumn(
        "is_drift", F.when(F.col("severity") == "NONE", 0).otherwise(1).cast("long"))
