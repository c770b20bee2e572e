"""Per-window feature drift: statistics, correction for many tests, severities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import drift_stats as S
from fleetlens.operators.drift_windows import DriftConfig, category_pane_counts, pane_counts, panes_to_windows
from fleetlens.operators.whatif import without_copies
from fleetlens.ordering import OrderBlocks
from fleetlens.schemas import KINEMATIC_FEATURES, WEATHER_FEATURES
from fleetlens.session import materialize

# fixed values: window means at which weather counts as disturbed
RAIN_MEANS = (3.0, 5.0, 10.0)
HUMIDITY_MEANS = (92.0, 95.0)
HEAVY_RAIN_CODE = 63
HEAVY_RAIN_SHARES = (0.25, 0.50)
WEATHER_Z = (3.0, 4.0)
PEAK_MEAN = 0.8


def window_feature_stats(rows: DataFrame, features: Sequence[str], profile: DataFrame, reference: DataFrame,
                         keys: Sequence[str] = (), cfg: DriftConfig = DriftConfig(),
                         blocks: OrderBlocks | None = None, shared: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """PSI, JS, KS, adjusted p and means per (keys, window, feature) of indexed wide rows.

    All statistics come from one table of value counts per pane; sums and bins are
    reduced per pane before panes are repeated for their windows. ``shared`` (``whatif.shared_columns``) names the scenarios
    that have the same values of a feature: one of them is computed, and its windows are repeated for the others before the
    correction for many tests.
    """
    keys = list(keys)
    rows = without_copies(rows, shared) if shared else rows
    per = [*keys, "window_id", "feature"]
    pane = [*keys, "n", "pane"]
    counts = materialize(pane_counts(rows, keys, features, cfg), "pane-counts")  # read four times
    c, v = F.col("records"), F.col("value")
    sums = counts.groupBy(*pane, "feature").agg(
        F.sum(c).alias("_n"), F.sum(v * c).alias("_s"), F.sum(F.when(v >= HEAVY_RAIN_CODE, c).otherwise(0)).alias("_h"))
    means = panes_to_windows(sums, cfg).groupBy(*per).agg(
        F.sum("_n").alias("sample_count"), (F.sum("_s") / F.sum("_n")).alias("curr_mean"),
        (F.sum("_h") / F.sum("_n")).alias("share_heavy"))
    bins = panes_to_windows(S.binned_counts(counts, profile, pane, "records"), cfg).groupBy(*per, "bin").agg(
        F.sum("records").alias("records"))
    distances = S.binned_distances(S.binned_counts(reference, profile), bins, profile, [*keys, "window_id"])
    ranked = counts.join(S.reference_ranks(reference, counts, blocks), ["feature", "value"])
    ks = S.ks_from_ranks(panes_to_windows(ranked, cfg), per, "records").drop("current_count", "reference_count")
    tests = means.join(distances, per).join(ks, per)
    tested = S.benjamini_hochberg(repeated(tests, shared) if shared else tests, [*keys, "window_id"], alpha=cfg.ks_alpha)
    return tested.join(profile.select("feature", F.col("mean").alias("ref_mean"), F.col("std").alias("ref_std"),
                                      F.col("sample_count").alias("ref_sample_count")), "feature")


def repeated(tests: DataFrame, shared: dict[str, dict[str, list[str]]], key: str = "scenario_id") -> DataFrame:
    """Rows of a scenario and feature, and the same for the scenarios that share the feature's values with it."""
    own = F.array(F.col(key))
    to = F.lit(None)
    for group in {str(g): g for g in shared.values()}.values():
        names = [f for f, g in shared.items() if g == group]
        for first, others in group.items():
            to = F.when(F.col("feature").isin(names) & (F.col(key) == first), F.concat(own, F.array(*[F.lit(x) for x in others]))).otherwise(to)
    return tests.withColumn(key, F.explode(F.coalesce(to, own)))


def kinematic_severity(cfg: DriftConfig = DriftConfig()) -> Column:
    psi, ks = F.col("psi"), (F.col("ks_statistic") >= cfg.ks_critical) & (F.col("rejected") == 1)
    return (F.when(psi >= cfg.psi_critical, "CRITICAL").when((psi >= cfg.psi_drift) & ks, "HIGH")
            .when((psi >= cfg.psi_drift) | ks, "MEDIUM").when(psi >= cfg.psi_warning, "LOW").otherwise("NONE"))


def weather_severity() -> Column:
    mean, psi, name = F.col("curr_mean"), F.col("psi"), F.col("feature")
    rain = (F.when(mean >= RAIN_MEANS[2], "CRITICAL").when(mean >= RAIN_MEANS[1], "HIGH")
            .when(mean >= RAIN_MEANS[0], "MEDIUM").otherwise("NONE"))
    humid = (F.when(mean >= HUMIDITY_MEANS[1], "HIGH")
             .when((mean >= HUMIDITY_MEANS[0]) & (psi >= 0.25), "MEDIUM").otherwise("NONE"))
    code = (F.when(F.col("share_heavy") >= HEAVY_RAIN_SHARES[1], "HIGH")
            .when(F.col("share_heavy") >= HEAVY_RAIN_SHARES[0], "MEDIUM").otherwise("NONE"))
    z = F.abs(mean - F.col("ref_mean")) / F.greatest(F.col("ref_std"), F.lit(0.1))
    other = F.when(z >= WEATHER_Z[1], "HIGH").when(z >= WEATHER_Z[0], "LOW").otherwise("NONE")
    return (F.when(name.isin("precipitation", "rain"), rain).when(name == "relative_humidity_2m", humid)
            .when(name == "weather_code", code).otherwise(other))


def context_severity() -> Column:
    return F.when((F.col("feature") == "is_peak_period") & (F.col("curr_mean") >= PEAK_MEAN), "LOW").otherwise("NONE")


def classify_numeric(stats: DataFrame, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Severity by feature family; only MEDIUM and above are drift."""
    name = F.col("feature")
    family = (F.when(name.isin(KINEMATIC_FEATURES), "kinematic").when(name.isin(WEATHER_FEATURES), "environmental")
              .otherwise("context"))
    severity = (F.when(F.col("category") == "kinematic", kinematic_severity(cfg))
                .when(F.col("category") == "environmental", weather_severity()).otherwise(context_severity()))
    return stats.withColumn("category", family).withColumn("severity", severity).withColumn(
        "is_drift", F.when(F.col("severity").isin("MEDIUM", "HIGH", "CRITICAL"), 1).otherwise(0).cast("long"))


def window_category_stats(rows: DataFrame, features: Sequence[str], reference: DataFrame, keys: Sequence[str] = (),
                          cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """PSI per (keys, window, category column) of indexed wide rows.

    ``reference`` is a ``categorical_profile``. Categories are counted per pane, and panes are summed for their windows.
    ``sample_count`` is the window's records, those without a category too; a window without any category has no PSI.
    """
    keys = list(keys)
    per = [*keys, "window_id", "feature"]
    panes = category_pane_counts(rows, keys, features, cfg)
    windows = panes_to_windows(panes, cfg).groupBy(*per, "category").agg(F.sum("records").alias("records"))
    sizes = windows.groupBy(*per).agg(F.sum("records").alias("sample_count"))
    psi = S.categorical_psi(reference, windows.filter(F.col("category").isNotNull()), [*keys, "window_id"])
    known = reference.groupBy("feature").agg(F.sum("records").alias("ref_sample_count"))
    return sizes.join(psi, per, "left").join(known, "feature")


def classify_categorical(stats: DataFrame, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Category shifts warn at most."""
    return stats.withColumns({
        "category": F.lit("context"), "severity": F.when(F.col("psi") >= cfg.categorical_low, "LOW").otherwise("NONE"),
        "is_drift": F.lit(0).cast("long")})


RESULT = ["feature", "feature_type", "detector", "category", "psi", "threshold", "js_distance", "ks_statistic", "adjusted_p", "curr_mean",
          "ref_mean", "categories", "sample_count", "ref_sample_count", "severity", "is_drift"]


def feature_results(numeric: DataFrame, categorical: DataFrame, keys: Sequence[str] = (), cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """One row per (keys, window, feature) of classified numeric and category columns; what a kind lacks is null."""
    kinds = ((numeric, "numerical", "PSI_KS_HYBRID", cfg.psi_drift), (categorical, "categorical", "CATEGORICAL_PSI", cfg.categorical_threshold))
    parts = [stats.withColumns({"feature_type": F.lit(kind), "detector": F.lit(detector), "threshold": F.lit(threshold)})
             for stats, kind, detector, threshold in kinds]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).select(*keys, "window_id", *RESULT)


def feature_ranking(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Features ordered by how strongly they moved over all windows."""
    return results.groupBy(*keys, "feature").agg(
        F.max("psi").alias("max_psi"), F.percentile("psi", F.lit(0.5)).alias("median_psi"),
        F.max("ks_statistic").alias("max_ks"), F.min("adjusted_p").alias("min_p"),
        F.max("js_distance").alias("max_js"), F.sum("is_drift").alias("windows_flagged"),
        F.count(F.lit(1)).alias("windows"))
