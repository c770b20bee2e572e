"""Queries over drift: profiles, distances, windows, detectors and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import drift_detect, drift_events, drift_stats, drift_windows, evaluation, sequential, whatif
from fleetlens.operators.drift_windows import DriftConfig
from fleetlens.ordering import OrderBlocks, order_blocks, small_like
from fleetlens.plans import testbed as T
from fleetlens.plans.evaluation_queries import predict_again, scenario_sql, SCENARIO_SQL
from fleetlens.plans.registry import clean_time, cte, query, rounded, s6
from fleetlens.schemas import CATEGORICAL_FEATURES, KINEMATIC_FEATURES, WEATHER_FEATURES
from fleetlens.session import materialize

FEATURES = T.DRIFT_FEATURES
# references of the derived data; its errors are larger than the ones behind the defaults
CFG = DriftConfig(reference_mae=38.77, reference_rmse=60.83, ph_lambda=12.0)


def inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    """(reference, current): the first 70 % of the stream, and the rest with positions from 0.

    Both are read many times, so the scored rows are written once.
    """
    rows = materialize(T.scored_stream(spark, d), "scored")
    cut = F.floor(F.col("n") * F.lit(0.7))
    reference = rows.filter(F.col("idx") < cut)
    current = rows.filter(F.col("idx") >= cut).withColumns({"idx": F.col("idx") - cut, "n": F.col("n") - cut})
    return reference, current


def _long_sql(source: str, keys: str) -> str:
    head = f"{keys}, " if keys else ""
    return " UNION ALL ".join(f"SELECT {head}'{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {source}" for c in FEATURES)


def _categories_sql(source: str, keys: str) -> str:
    head = f"{keys}, " if keys else ""
    return " UNION ALL ".join(f"SELECT {head}'{c}' AS feature, CAST({c} AS VARCHAR) AS category, count(*) AS records FROM {source} GROUP BY ALL"
                              for c in CATEGORICAL_FEATURES)


cte("ref", "SELECT * FROM scored WHERE idx < floor(n * 0.7::DOUBLE)", "scored")
cte("cur", """SELECT * REPLACE (CAST(idx - floor(n * 0.7::DOUBLE) AS BIGINT) AS idx, CAST(n - floor(n * 0.7::DOUBLE) AS BIGINT) AS n),
  'BASELINE' AS scenario_id FROM scored WHERE idx >= floor(n * 0.7::DOUBLE)""", "scored")
cte("ref_long", _long_sql("ref", ""), "ref")
_DECILES = "[" + ", ".join(repr(i / 10) for i in range(11)) + "]"
_NINTHS = "[" + ", ".join(repr(i / 9) for i in range(10)) + "]"
cte("ref_low", "SELECT *, min(value) OVER (PARTITION BY feature) AS low FROM ref_long", "ref_long")
cte("profile", f"""SELECT feature, count(*) AS sample_count, CAST(0 AS BIGINT) AS missing_count, avg(value) AS mean, stddev_pop(value) AS std,
  min(value) AS min, quantile_cont(value, 0.25) AS q25, median(value) AS median, quantile_cont(value, 0.75) AS q75, max(value) AS max,
  CASE WHEN count(*) FILTER (WHERE value = low) >= 0.25 * count(*) AND count(*) FILTER (WHERE value > low) > 0 THEN
      list_sort(list_distinct(list_concat([min(low) - 1e-4::DOUBLE, min(low) + 1e-4::DOUBLE], quantile_cont(value, {_NINTHS}) FILTER (WHERE value > low))))
    WHEN count(*) FILTER (WHERE value = low) >= 0.25 * count(*) THEN [min(low) - 1.0::DOUBLE, min(low) + 1.0::DOUBLE]
    WHEN len(list_distinct(quantile_cont(value, {_DECILES}))) < 2 THEN [min(value) - 1e-3::DOUBLE, max(value) + 1e-3::DOUBLE]
    ELSE list_sort(list_distinct(quantile_cont(value, {_DECILES}))) END AS edges FROM ref_low GROUP BY 1""", "ref_low")
cte("grid", "SELECT feature, len(edges) - 1 AS bins, unnest(range(len(edges) - 1)) AS bin FROM profile", "profile")
_BIN = "len(list_filter(edges[2:len(edges) - 1], lambda e: e <= value))"
cte("ref_bins", f"SELECT feature, {_BIN} AS bin, count(*) AS r FROM ref_long JOIN profile USING (feature) GROUP BY ALL", "ref_long", "profile")
cte("ref_cdf", """SELECT feature, value, sum(count(*)) OVER (PARTITION BY feature ORDER BY value) / sum(count(*)) OVER (PARTITION BY feature) AS f
  FROM ref_long GROUP BY feature, value""", "ref_long")
cte("ref_sizes", "SELECT feature, count(*) AS n_ref FROM ref_long GROUP BY 1", "ref_long")

_FULL = "(CASE WHEN n >= 500 THEN (n - 500) // 250 + 1 ELSE 0 END)"
_LAST = f"(CASE WHEN n - {_FULL} * 250 >= 100 THEN {_FULL} ELSE {_FULL} - 1 END)"


def window_ctes(prefix: str, source: str) -> None:
    """Windowed statistics of a table with scenario_id, idx and n."""
    def c(name: str) -> str:
        return f"{prefix}_{name}"

    cte(c("win"), f"""SELECT *, CAST(unnest(range(greatest(CAST(floor((idx - 500) / 250.0) AS BIGINT) + 1, 0), least(idx // 250, {_LAST}) + 1)) AS BIGINT)
      AS window_id FROM {source}""", source)
    cte(c("long"), _long_sql(c("win"), "scenario_id, window_id"), c("win"))
    cte(c("bins"), f"SELECT scenario_id, window_id, feature, {_BIN} AS bin, count(*) AS c FROM {c('long')} JOIN profile USING (feature) GROUP BY ALL",
        c("long"), "profile")
    cte(c("shares"), f"""SELECT *, (r + 1.0) / (nr + bins) AS p, (c + 1.0) / (nc + bins) AS q,
      greatest(r / nr, 1e-5) AS jp, greatest(c / nc, 1e-5) AS jq FROM (
      SELECT w.scenario_id, w.window_id, g.feature, g.bin, g.bins, coalesce(r, 0) AS r, coalesce(c, 0) AS c,
        sum(coalesce(r, 0)) OVER w1 AS nr, sum(coalesce(c, 0)) OVER w1 AS nc
      FROM (SELECT DISTINCT scenario_id, window_id FROM {c('win')}) w CROSS JOIN grid g LEFT JOIN ref_bins USING (feature, bin)
      LEFT JOIN {c('bins')} b ON b.scenario_id = w.scenario_id AND b.window_id = w.window_id AND b.feature = g.feature AND b.bin = g.bin
      WINDOW w1 AS (PARTITION BY w.scenario_id, w.window_id, g.feature))""", c("win"), "grid", "ref_bins", c("bins"))
    cte(c("dist"), f"""SELECT scenario_id, window_id, feature, greatest(sum((q - p) * ln(q / p)), 0) AS psi,
      least(sqrt(greatest(0.5 * sum(a * log2(a / (0.5 * (a + b))) + b * log2(b / (0.5 * (a + b)))), 0)), 1) AS js_distance
      FROM (SELECT *, jp / sum(jp) OVER w1 AS a, jq / sum(jq) OVER w1 AS b FROM {c('shares')}
        WINDOW w1 AS (PARTITION BY scenario_id, window_id, feature)) GROUP BY ALL""", c("shares"))
    cte(c("steps"), f"""SELECT scenario_id, window_id, feature, value, count(*) AS k, sum(count(*)) OVER w1 AS upto,
      sum(count(*)) OVER (PARTITION BY scenario_id, window_id, feature) AS m FROM {c('long')} GROUP BY scenario_id, window_id, feature, value
      WINDOW w1 AS (PARTITION BY scenario_id, window_id, feature ORDER BY value)""", c("long"))
    cte(c("ks"), f"""SELECT scenario_id, window_id, feature, max(greatest(abs(upto / m - coalesce(f1, 0)), abs((upto - k) / m - coalesce(f0, 0)))) AS ks_statistic,
      max(m) AS m FROM (SELECT s.*, r.f AS f1 FROM {c('steps')} s ASOF LEFT JOIN ref_cdf r ON s.feature = r.feature AND s.value >= r.value)
      JOIN (SELECT s.scenario_id, s.window_id, s.feature, s.value, r.f AS f0 FROM {c('steps')} s ASOF LEFT JOIN ref_cdf r
        ON s.feature = r.feature AND s.value > r.value) USING (scenario_id, window_id, feature, value) GROUP BY ALL""", c("steps"), "ref_cdf")
    cte(c("p"), f"""SELECT *, CASE WHEN x < 0.2 THEN 1.0 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101),
      lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * x * x))), 0), 1) END AS p_value
      FROM (SELECT *, ks_statistic * sqrt(m * n_ref / (m + n_ref)) AS x FROM {c('ks')} JOIN ref_sizes USING (feature))""", c("ks"), "ref_sizes")
    cte(c("bh"), f"""SELECT *, least(min(scaled) OVER (PARTITION BY scenario_id, window_id ORDER BY p_value, feature
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS adjusted_p FROM (SELECT *, p_value * count(*) OVER (PARTITION BY scenario_id, window_id)
      / row_number() OVER (PARTITION BY scenario_id, window_id ORDER BY p_value, feature) AS scaled FROM {c('p')})""", c("p"))
    kin = ", ".join(f"'{f}'" for f in KINEMATIC_FEATURES)
    env = ", ".join(f"'{f}'" for f in WEATHER_FEATURES)
    cte(c("stats"), f"""SELECT d.*, b.ks_statistic, b.p_value, b.adjusted_p, CAST(b.adjusted_p <= 0.05 AS BIGINT) AS rejected, m.curr_mean, m.sample_count,
      m.share_heavy, f.mean AS ref_mean, f.std AS ref_std, f.sample_count AS ref_sample_count FROM {c('dist')} d
      JOIN {c('bh')} b USING (scenario_id, window_id, feature) JOIN (SELECT scenario_id, window_id, feature, avg(value) AS curr_mean,
        count(*) AS sample_count, avg(CASE WHEN value >= 63 THEN 1.0 ELSE 0.0 END) AS share_heavy FROM {c('long')} GROUP BY ALL) m
        USING (scenario_id, window_id, feature) JOIN profile f USING (feature)""", c("dist"), c("bh"), c("long"), "profile")
    cte(c("judged"), f"""SELECT *, CASE WHEN feature IN ({kin}) THEN 'kinematic' WHEN feature IN ({env}) THEN 'environmental' ELSE 'context' END AS category,
      CASE WHEN feature IN ({kin}) THEN CASE WHEN psi >= 0.45 THEN 'CRITICAL' WHEN psi >= 0.25 AND ks_statistic >= 0.18 AND rejected = 1 THEN 'HIGH'
          WHEN psi >= 0.25 OR (ks_statistic >= 0.18 AND rejected = 1) THEN 'MEDIUM' WHEN psi >= 0.15 THEN 'LOW' ELSE 'NONE' END
        WHEN feature IN ('precipitation', 'rain') THEN CASE WHEN curr_mean >= 10 THEN 'CRITICAL' WHEN curr_mean >= 5 THEN 'HIGH' WHEN curr_mean >= 3 THEN 'MEDIUM' ELSE 'NONE' END
        WHEN feature = 'relative_humidity_2m' THEN CASE WHEN curr_mean >= 95 THEN 'HIGH' WHEN curr_mean >= 92 AND psi >= 0.25 THEN 'MEDIUM' ELSE 'NONE' END
        WHEN feature = 'weather_code' THEN CASE WHEN share_heavy >= 0.5 THEN 'HIGH' WHEN share_heavy >= 0.25 THEN 'MEDIUM' ELSE 'NONE' END
        WHEN feature IN ({env}) THEN CASE WHEN abs(curr_mean - ref_mean) / greatest(ref_std, 0.1) >= 4 THEN 'HIGH'
          WHEN abs(curr_mean - ref_mean) / greatest(ref_std, 0.1) >= 3 THEN 'LOW' ELSE 'NONE' END
        WHEN feature = 'is_peak_period' AND curr_mean >= 0.8 THEN 'LOW' ELSE 'NONE' END AS severity FROM {c('stats')}""", c("stats"))
    cte(c("perf_rows"), f"""SELECT *, CAST(unnest(list_concat(list_filter(range(greatest(CAST(floor((idx - 500) / 250.0) AS BIGINT) + 1, 0), least(idx // 250, {_LAST}) + 1),
        lambda w: w < {_FULL}), CASE WHEN idx >= n - 500 AND n - {_FULL} * 250 >= 100 THEN [{_FULL}] ELSE [] END)) AS BIGINT) AS window_id FROM {source}""", source)
    cte(c("perf"), f"""SELECT *, CASE WHEN greatest(mae_ratio, rmse_ratio) >= 2.2 THEN 'CRITICAL' WHEN greatest(mae_ratio, rmse_ratio) >= 1.6 THEN 'HIGH'
      WHEN mae_ratio >= 1.3 THEN 'MEDIUM' ELSE 'NONE' END AS severity FROM (SELECT *, mae / 38.77 AS mae_ratio, rmse / 60.83 AS rmse_ratio FROM (
      SELECT scenario_id, window_id, min(idx) AS window_start_idx, max(idx) AS window_end_idx, count(*) AS sample_count, avg(abs(actual - predicted)) AS mae,
        sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse, median(abs(actual - predicted)) AS median_ae,
        quantile_cont(abs(actual - predicted), 0.9) AS p90_error, quantile_cont(abs(actual - predicted), 0.95) AS p95_error,
        avg(actual - predicted) AS mean_signed_error, var_pop(actual - predicted) AS error_variance,
        avg(CASE WHEN actual > predicted THEN 1.0 ELSE 0.0 END) AS underestimation_rate FROM {c('perf_rows')} GROUP BY ALL))""", c("perf_rows"))
    cte(c("bounds"), f"SELECT scenario_id, window_id, min(idx) AS window_start_idx, max(idx) AS window_end_idx FROM {c('win')} GROUP BY ALL", c("win"))
    ranks = "['NONE', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL']"
    cte(c("events"), f"""SELECT scenario_id, 'DRIFT_DATA_' || scenario_id || printf('_W%04d', window_id + 1) AS event_id, 'DATA_DRIFT' AS drift_type,
        {ranks}[max(list_position({ranks}, severity))] AS severity, 'PSI_KS_HYBRID' AS detector, any_value(b.window_start_idx) AS window_start_idx,
        any_value(b.window_end_idx) AS window_end_idx, max(psi) AS statistic, min(adjusted_p) AS p_value,
        string_agg(feature, ',' ORDER BY feature) AS affected_features
      FROM {c('judged')} JOIN {c('bounds')} b USING (scenario_id, window_id) WHERE severity IN ('MEDIUM', 'HIGH', 'CRITICAL') GROUP BY scenario_id, window_id
      UNION ALL SELECT scenario_id, 'DRIFT_PERF_' || scenario_id || printf('_W%04d', window_id + 1), 'PERFORMANCE_DRIFT', severity, 'RollingPerformanceMonitor',
        window_start_idx, window_end_idx, mae_ratio, NULL, 'mae_sec,rmse_sec' FROM {c('perf')} WHERE severity <> 'NONE'""",
        c("judged"), c("bounds"), c("perf"))


window_ctes("one", "cur")
cte("cur_all", f"""SELECT * REPLACE ({T._prediction_sql(0.75)} AS predicted) FROM (""" + " UNION ALL BY NAME ".join(
    f"SELECT * REPLACE ('{s}' AS scenario_id) FROM ({scenario_sql(s, 'cur')})" for s in SCENARIO_SQL) + ")", "cur")
window_ctes("all", "cur_all")

KEYS = ["scenario_id", "window_id"]


def one_scenario(current: DataFrame) -> DataFrame:
    return current.withColumn("scenario_id", F.lit("BASELINE"))


def reference_long(reference: DataFrame) -> DataFrame:
    return drift_stats.feature_rows(reference, [], FEATURES)


def value_blocks(rows: DataFrame) -> OrderBlocks | None:
    """Counting stored rows is cheap; only a large table needs cut points for its values."""
    return (small_like(order_blocks(rows.select("idx"), "idx"), "value") or {}).get("value")


def profile_of(reference: DataFrame) -> DataFrame:
    """Profiles are a row per feature; written so that every use reads the same edges."""
    return materialize(drift_stats.numeric_profile(reference_long(reference), blocks=value_blocks(reference)), "profile")


def windowed_long(rows: DataFrame) -> DataFrame:
    return drift_stats.feature_rows(drift_windows.sliding_windows(rows), KEYS, FEATURES)


def judged(rows: DataFrame, reference: DataFrame, shared: dict | None = None) -> DataFrame:
    stats = drift_detect.window_feature_stats(rows, FEATURES, profile_of(reference), reference_long(reference), ["scenario_id"], CFG,
                                              value_blocks(reference), shared)
    return drift_detect.classify_numeric(stats, CFG)


_PROFILE = ["mean", "std", "min", "q25", "median", "q75", "max"]


@query("o01_reference_profile", "SELECT feature, sample_count, missing_count, " + ", ".join(f"{s6(c)} AS {c}" for c in _PROFILE) + " FROM profile", ("profile",))
def reference_profile(spark, d):
    out = profile_of(inputs(spark, d)[0])
    return rounded(out.select("feature", "sample_count", "missing_count", *_PROFILE), *_PROFILE)


@query("o01_bin_edges", f"SELECT feature, CAST(i - 1 AS BIGINT) AS position, {s6('edges[i]')} AS edge FROM (SELECT *, unnest(range(1, len(edges) + 1)) AS i FROM profile)", ("profile",))
def bin_edges(spark, d):
    out = profile_of(inputs(spark, d)[0])
    return rounded(out.select("feature", F.posexplode("bin_edges").alias("position", "edge")).withColumn("position", F.col("position").cast("long")), "edge")


@query("o01_category_profile", _categories_sql("ref", ""), ("ref",))
def category_profile(spark, d):
    return drift_stats.categorical_profile(inputs(spark, d)[0], CATEGORICAL_FEATURES)


@query("o02_psi", f"""SELECT feature, {s6('psi')} AS psi FROM (SELECT feature, greatest(sum((q - p) * ln(q / p)), 0) AS psi FROM (
  SELECT *, (r + 1.0) / (sum(r) OVER w + bins) AS p, (c + 1.0) / (sum(c) OVER w + bins) AS q FROM (
    SELECT g.*, coalesce(r, 0) AS r, coalesce(c, 0) AS c FROM grid g LEFT JOIN ref_bins USING (feature, bin) LEFT JOIN (
      SELECT feature, {_BIN} AS bin, count(*) AS c FROM ({_long_sql('cur', '')}) JOIN profile USING (feature) GROUP BY ALL) USING (feature, bin))
  WINDOW w AS (PARTITION BY feature)) GROUP BY 1)""", ("grid", "ref_bins", "cur"))
def psi(spark, d):
    reference, current = inputs(spark, d)
    profile = profile_of(reference)
    bins = [drift_stats.binned_counts(drift_stats.feature_rows(x, [], FEATURES), profile) for x in (reference, current)]
    return rounded(drift_stats.binned_distances(*bins, profile).select("feature", "psi"), "psi")


@query("o02_psi_components", f"""SELECT window_id, feature, bin, CAST(r AS BIGINT) AS ref_count, CAST(c AS BIGINT) AS cur_count, {s6('p')} AS ref_share,
  {s6('q')} AS cur_share, {s6('(q - p) * ln(q / p)')} AS psi_component FROM one_shares""", ("one_shares",))
def psi_components(spark, d):
    reference, current = inputs(spark, d)
    profile = profile_of(reference)
    long = windowed_long(one_scenario(current)).drop("scenario_id")
    out = drift_stats.binned_distances(drift_stats.binned_counts(reference_long(reference), profile),
                                       drift_stats.binned_counts(long, profile, ["window_id"]), profile, ["window_id"], components=True)
    return rounded(out.withColumn("bin", F.col("bin").cast("long")), "ref_share", "cur_share", "psi_component")


_TWO_SAMPLE = f"""SELECT feature, value, f1, f2, lead(value) OVER (PARTITION BY feature ORDER BY value) - value AS gap, n1, n2 FROM (
  SELECT feature, value, sum(r) OVER w / sum(r) OVER p AS f1, sum(c) OVER w / sum(c) OVER p AS f2, sum(r) OVER p AS n1, sum(c) OVER p AS n2 FROM (
    SELECT feature, value, sum(r) AS r, sum(c) AS c FROM (SELECT feature, value, 1 AS r, 0 AS c FROM ref_long
      UNION ALL SELECT feature, value, 0, 1 FROM ({_long_sql('cur', '')})) GROUP BY ALL)
  WINDOW w AS (PARTITION BY feature ORDER BY value), p AS (PARTITION BY feature))"""


@query("o03_ks_test", f"""SELECT feature, {s6('dd')} AS ks_statistic, {s6('''CASE WHEN x < 0.2 THEN 1.0 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101),
  lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * x * x))), 0), 1) END''')} AS p_value FROM (SELECT feature, dd, dd * sqrt(n1 * n2 / (n1 + n2)) AS x
  FROM (SELECT feature, max(abs(f1 - f2)) AS dd, max(n1) AS n1, max(n2) AS n2 FROM ({_TWO_SAMPLE}) GROUP BY 1))""", ("ref_long", "cur"))
def ks_test(spark, d):
    reference, current = inputs(spark, d)
    out = drift_stats.ks_two_sample(reference_long(reference), drift_stats.feature_rows(current, [], FEATURES),
                                    blocks=value_blocks(reference))
    return rounded(out.select("feature", "ks_statistic", "p_value"), "ks_statistic", "p_value")


cte("next_windows", f"""SELECT * FROM (SELECT * REPLACE (CASE side WHEN 'c' THEN window_id - 1 ELSE window_id END AS window_id) FROM (
    SELECT side, idx // 500 AS window_id, feature, value FROM (SELECT unnest(['r', 'c']) AS side, idx, n, feature, value FROM ({_long_sql('scored', 'idx, n')})) WHERE idx // 500 < n // 500))
  WHERE window_id >= 0 AND window_id < (SELECT max(n) // 500 - 1 FROM scored)""", "scored")


@query("o03_exact_p_values", f"""SELECT window_id, feature, {s6('ks')} AS ks_statistic, {s6("""CASE WHEN h = 0 THEN 1 ELSE least(2 * list_sum(list_transform(range(1, 500 // h + 1),
    lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(2 * lgamma(501) - lgamma(501 - k * h) - lgamma(501 + k * h)))), 1) END""")} AS p_value
  FROM (SELECT window_id, feature, ks, CAST(round(ks * 500) AS BIGINT) AS h FROM (SELECT window_id, feature, max(abs(r - c)) / 500.0 AS ks FROM (
    SELECT window_id, feature, value, sum(sum(CASE side WHEN 'r' THEN 1 ELSE 0 END)) OVER w AS r, sum(sum(CASE side WHEN 'c' THEN 1 ELSE 0 END)) OVER w AS c
    FROM next_windows GROUP BY window_id, feature, value WINDOW w AS (PARTITION BY window_id, feature ORDER BY value)) GROUP BY 1, 2))""", ("next_windows",))
def exact_p_values(spark, d):
    """Each full window of 500 records against the next one."""
    rows = materialize(T.scored_stream(spark, d), "scored").withColumn("window_id", F.floor(F.col("idx") / 500))
    rows = rows.filter(F.col("window_id") < F.floor(F.col("n") / 500))
    late = rows.withColumn("window_id", F.col("window_id") - 1)
    first, second = (drift_stats.feature_rows(x, ["window_id"], FEATURES) for x in (rows, late))
    found = drift_stats.with_exact_p(drift_stats.ks_two_sample(first, second, ("window_id", "feature")))
    return rounded(found.select("window_id", "feature", "ks_statistic", "p_value"), "ks_statistic", "p_value")


@query("o06_wasserstein", f"SELECT feature, {s6('coalesce(sum(abs(f1 - f2) * gap), 0)')} AS wasserstein FROM ({_TWO_SAMPLE}) GROUP BY 1", ("ref_long", "cur"))
def wasserstein(spark, d):
    reference, current = inputs(spark, d)
    out = drift_stats.ks_two_sample(reference_long(reference), drift_stats.feature_rows(current, [], FEATURES),
                                    blocks=value_blocks(reference))
    return rounded(out.select("feature", "wasserstein"), "wasserstein")


@query("o04_benjamini_hochberg", f"SELECT window_id, feature, {s6('adjusted_p')} AS adjusted_p, CAST(adjusted_p <= 0.05 AS BIGINT) AS rejected FROM one_bh", ("one_bh",))
def benjamini_hochberg(spark, d):
    reference, current = inputs(spark, d)
    ks = drift_stats.windowed_ks(reference_long(reference), windowed_long(one_scenario(current)), KEYS, value_blocks(reference))
    out = drift_stats.benjamini_hochberg(ks, KEYS)
    return rounded(out.select("window_id", "feature", "adjusted_p", "rejected"), "adjusted_p")


@query("o05_jensen_shannon", f"SELECT window_id, feature, {s6('js_distance')} AS js_distance FROM one_dist", ("one_dist",))
def jensen_shannon(spark, d):
    reference, current = inputs(spark, d)
    profile = profile_of(reference)
    out = drift_stats.binned_distances(drift_stats.binned_counts(reference_long(reference), profile),
                                       drift_stats.binned_counts(windowed_long(one_scenario(current)), profile, KEYS), profile, KEYS)
    return rounded(out.select("window_id", "feature", "js_distance"), "js_distance")


cte("one_categories", f"""SELECT window_id, feature, greatest(sum((q - p) * ln(q / p)), 0) AS psi, count(*) AS categories, CAST(max(n_cur) AS BIGINT) AS sample_count,
  CAST(max(n_ref) AS BIGINT) AS ref_sample_count FROM (
  SELECT *, rp / sum(rp) OVER w AS p, cp / sum(cp) OVER w AS q FROM (SELECT k.window_id, k.feature, k.category, sum(r.records) OVER v AS n_ref, sum(c.records) OVER v AS n_cur,
    greatest(coalesce(r.records, 0) / sum(coalesce(r.records, 0)) OVER v, 1e-4) AS rp, greatest(coalesce(c.records, 0) / sum(coalesce(c.records, 0)) OVER v, 1e-4) AS cp
    FROM (SELECT DISTINCT w.window_id, x.feature, x.category FROM (SELECT DISTINCT window_id FROM one_win) w, ({_categories_sql('ref', '')}) x
          UNION SELECT window_id, feature, category FROM ({_categories_sql('one_win', 'window_id')})) k
    LEFT JOIN ({_categories_sql('ref', '')}) r USING (feature, category)
    LEFT JOIN ({_categories_sql('one_win', 'window_id')}) c ON c.window_id = k.window_id AND c.feature = k.feature AND c.category = k.category
    WINDOW v AS (PARTITION BY k.window_id, k.feature)) WINDOW w AS (PARTITION BY window_id, feature)) GROUP BY ALL""", "ref", "one_win")
cte("one_results", """SELECT window_id, feature, 'numerical' AS feature_type, 'PSI_KS_HYBRID' AS detector, category, psi, 0.25::DOUBLE AS threshold, js_distance, ks_statistic,
    adjusted_p, curr_mean, ref_mean, CAST(NULL AS BIGINT) AS categories, sample_count, ref_sample_count, severity FROM one_judged
  UNION ALL SELECT window_id, feature, 'categorical', 'CATEGORICAL_PSI', 'context', psi, 0.25::DOUBLE, NULL, NULL, NULL, NULL, NULL, categories, sample_count,
    ref_sample_count, CASE WHEN psi >= 0.6 THEN 'LOW' ELSE 'NONE' END FROM one_categories""", "one_judged", "one_categories")


@query("o07_categorical_psi", f"SELECT window_id, feature, {s6('psi')} AS psi, categories FROM one_categories", ("one_categories",))
def categorical_psi(spark, d):
    reference, current = inputs(spark, d)
    out = drift_detect.window_category_stats(current, CATEGORICAL_FEATURES, drift_stats.categorical_profile(reference, CATEGORICAL_FEATURES))
    return rounded(out.select("window_id", "feature", "psi", "categories"), "psi")


def all_results(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """All 29 inputs of each window, judged."""
    vocabulary = materialize(drift_stats.categorical_profile(reference, CATEGORICAL_FEATURES), "categories")
    stats = drift_detect.window_category_stats(rows, CATEGORICAL_FEATURES, vocabulary, ["scenario_id"], CFG)
    return drift_detect.feature_results(judged(rows, reference), drift_detect.classify_categorical(stats, CFG), ["scenario_id"], CFG)


_STATS = ["psi", "js_distance", "ks_statistic", "adjusted_p", "curr_mean", "ref_mean"]


@query("o08_window_features", "SELECT window_id, feature, feature_type, detector, threshold, categories, sample_count, ref_sample_count, " + ", ".join(f"{s6(c)} AS {c}" for c in _STATS)
       + " FROM one_results", ("one_results",))
def window_features(spark, d):
    reference, current = inputs(spark, d)
    out = all_results(one_scenario(current), reference)
    return rounded(out.select("window_id", "feature", "feature_type", "detector", "threshold", "categories", "sample_count", "ref_sample_count", *_STATS), *_STATS)


@query("o09_count_windows", """SELECT window_id, min(i) AS window_start_idx, max(i) AS window_end_idx, count(*) AS sample_count FROM (
  SELECT i, CAST(unnest(range(greatest(CAST(floor((i - 500) / 250.0) AS BIGINT) + 1, 0), least(i // 250, %s) + 1)) AS BIGINT) AS window_id
  FROM split_obs) GROUP BY 1""" % _LAST, ("split_obs",))
def count_windows(spark, d):
    rows = drift_windows.indexed(T.observations(spark, d).select(*T.TIME_ORDER), T.TIME_ORDER, T.time_blocks(spark, d))
    return drift_windows.window_bounds(drift_windows.sliding_windows(rows))


def _severity_query(name: str, category: str):
    @query(name, f"""SELECT window_id, feature, severity, CAST(severity IN ('MEDIUM', 'HIGH', 'CRITICAL') AS BIGINT) AS is_drift
      FROM one_results WHERE category = '{category}'""", ("one_results",))
    def run(spark, d):
        reference, current = inputs(spark, d)
        out = all_results(one_scenario(current), reference).filter(F.col("category") == category)
        return out.select("window_id", "feature", "severity", "is_drift")
    return run


_severity_query("o10_kinematic_severity", "kinematic")
_severity_query("o11_environmental_severity", "environmental")
_severity_query("o12_context_severity", "context")

_PERF = ["mae", "rmse", "median_ae", "p90_error", "p95_error", "mean_signed_error", "error_variance", "underestimation_rate", "mae_ratio", "rmse_ratio"]


cte("stream_all", "SELECT *, 'BASELINE' AS scenario_id FROM scored", "scored")
window_ctes("st", "stream_all")


@query("o13_performance_windows", "SELECT window_id, window_start_idx, window_end_idx, sample_count, severity, CAST(severity <> 'NONE' AS BIGINT) AS is_drift, "
       + ", ".join(f"{s6(c)} AS {c}" for c in _PERF) + " FROM st_perf", ("st_perf",))
def performance_windows(spark, d):
    return rounded(drift_windows.performance_windows(T.scored_stream(spark, d), cfg=CFG), *_PERF)


def _alarms(rows: DataFrame, keys: list[str]) -> DataFrame:
    return drift_events.residual_alarms(rows, keys, ["idx"], "signed_error_sec", CFG)


def _page_hinkley_sql(source: str, key: str, cfg: DriftConfig) -> str:
    """Row by row: the deviation moves, its minimum follows, an alarm clears both."""
    std = repr(max((cfg.reference_rmse**2 - cfg.reference_mae**2), 25.0) ** 0.5)
    return f"""WITH RECURSIVE placed AS MATERIALIZED (SELECT {key}, idx, (abs(signed_error_sec) - {cfg.reference_mae}) / {std}::DOUBLE - {cfg.ph_delta}::DOUBLE AS step,
    row_number() OVER (PARTITION BY {key} ORDER BY idx) AS k FROM {source}),
  fold({key}, k, idx, u, low, statistic) AS (SELECT DISTINCT {key}, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM placed
    UNION ALL SELECT {key}, k, idx, CASE WHEN u - low >= {cfg.ph_lambda} THEN 0 ELSE u END, CASE WHEN u - low >= {cfg.ph_lambda} THEN 0 ELSE low END, u - low
    FROM (SELECT {key}, k, idx, u, least(low, u) AS low FROM (SELECT p.{key}, p.k, p.idx, {cfg.ph_alpha}::DOUBLE * f.u + p.step AS u, f.low FROM fold f JOIN placed p ON p.{key} = f.{key} AND p.k = f.k + 1)))
  SELECT {key}, idx, 'PageHinkley' AS detector, statistic, CASE WHEN statistic >= 1.5 * {cfg.ph_lambda} THEN 'CRITICAL' WHEN statistic >= {cfg.ph_lambda} THEN 'HIGH'
    WHEN statistic >= 0.6 * {cfg.ph_lambda} THEN 'MEDIUM' ELSE 'NONE' END AS severity, CAST(statistic >= {cfg.ph_lambda} AS INTEGER) AS in_drift FROM fold WHERE k > 0"""


def _split_window_sql(source: str, key: str, detector: sequential.SplitWindow) -> str:
    """Row by row: the window's start and the rows still to wait; halves come from running sums."""
    return f"""WITH RECURSIVE placed AS MATERIALIZED (SELECT {key}, idx, k, sum(e) OVER w AS total, sum(e * e) OVER w AS squares FROM (
      SELECT {key}, idx, abs(signed_error_sec) AS e, row_number() OVER (PARTITION BY {key} ORDER BY idx) AS k FROM {source}) WINDOW w AS (PARTITION BY {key} ORDER BY k)),
  sums AS MATERIALIZED (SELECT {key}, list_prepend(0::DOUBLE, list(total ORDER BY k)) AS t, list_prepend(0::DOUBLE, list(squares ORDER BY k)) AS q, max(k) AS rows FROM placed GROUP BY 1),
  fold({key}, k, low, wait, statistic, severity) AS (SELECT {key}, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0, 0::DOUBLE, 'NONE' FROM sums
    UNION ALL SELECT {key}, k, CASE WHEN alarm THEN mid ELSE low END, CASE WHEN alarm THEN {detector.cooldown} ELSE greatest(wait - 1, 0) END, CASE WHEN judged THEN abs(gap) ELSE 0 END,
      CASE WHEN NOT alarm THEN 'NONE' WHEN gap > 1.5 * cut THEN 'HIGH' ELSE 'MEDIUM' END
    FROM (SELECT *, coalesce(judged AND gap > cut AND gap >= {detector.min_gain}, false) AS alarm FROM (
      SELECT *, wait = 0 AND n >= {detector.min_window} AS judged, (t[k + 1] - t[mid + 1]) / (k - mid) - (t[mid + 1] - t[low + 1]) / greatest(mid - low, 1) AS gap,
        sqrt(2 * (1 / greatest(mid - low, 1) + 1 / (k - mid)) * ln(2 / {detector.delta}::DOUBLE)) * (sqrt(greatest((q[k + 1] - q[low + 1]) / n - pow((t[k + 1] - t[low + 1]) / n, 2), 0)) + 1) AS cut
      FROM (SELECT *, k - low AS n, low + (k - low) // 2 AS mid FROM (SELECT f.{key}, f.k + 1 AS k, greatest(f.low, f.k + 1 - {detector.max_window}) AS low, f.wait, s.t, s.q
        FROM fold f JOIN sums s ON s.{key} = f.{key} AND f.k < s.rows)))))
  SELECT {key}, idx, 'ADWIN' AS detector, statistic, severity, CAST(severity <> 'NONE' AS INTEGER) AS in_drift FROM fold JOIN placed USING ({key}, k)"""


_SMALL_GAIN = sequential.SplitWindow(min_gain=2.0)
cte("hinkley", _page_hinkley_sql("scored", "deviceid", CFG), "scored")
cte("split_small", _split_window_sql("scored", "direction", _SMALL_GAIN), "scored")
cte("split_device", _split_window_sql("scored", "deviceid", sequential.SplitWindow.from_config(CFG)), "scored")
_FOUND = f"detector, {s6('statistic')} AS statistic, severity, CAST(severity = 'MEDIUM' AS INTEGER) AS in_warning, in_drift"


@query("o14_page_hinkley", f"SELECT deviceid, idx, signed_error_sec, {_FOUND} FROM hinkley JOIN scored USING (deviceid, idx)", ("hinkley", "scored"))
def page_hinkley(spark, d):
    rows = T.scored_stream(spark, d).select("deviceid", "idx", "signed_error_sec")
    detector = sequential.PageHinkley.from_config(CFG)
    return rounded(sequential.detect(rows, ["deviceid"], ["idx"], "signed_error_sec", detector, alarms_only=False), "statistic")


@query("o15_split_window", f"SELECT direction, idx, signed_error_sec, {_FOUND} FROM split_small JOIN scored USING (direction, idx)", ("split_small", "scored"))
def split_window(spark, d):
    rows = T.scored_stream(spark, d).select("direction", "idx", "signed_error_sec")
    return rounded(sequential.detect(rows, ["direction"], ["idx"], "signed_error_sec", _SMALL_GAIN, alarms_only=False), "statistic")


@query("o16_residual_alarms", f"""SELECT deviceid, idx, signed_error_sec, {_FOUND}, mean_residual, variance_residual, CASE detector WHEN 'ADWIN' THEN {CFG.adwin_delta}::DOUBLE ELSE {CFG.ph_lambda}::DOUBLE END AS threshold
  FROM (SELECT * FROM hinkley UNION ALL SELECT * FROM split_device) JOIN (SELECT deviceid, idx, signed_error_sec, {s6('avg(signed_error_sec) OVER w')} AS mean_residual, {s6('var_pop(signed_error_sec) OVER w')} AS variance_residual
    FROM scored WINDOW w AS (PARTITION BY deviceid ORDER BY idx ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)) USING (deviceid, idx)
  WHERE in_drift = 1 OR severity = 'MEDIUM'""", ("hinkley", "split_device", "scored"))
def residual_alarms(spark, d):
    """Alarms and warnings of both detectors per device."""
    rows = T.stored_stream(spark, d, "deviceid", "signed_error_sec").select("deviceid", "idx", "signed_error_sec")
    found = drift_events.residual_alarms(rows, ["deviceid"], ["idx"], "signed_error_sec", CFG, alarms_only=False)
    return rounded(found.filter("in_drift = 1 or in_warning = 1"), "statistic", "mean_residual", "variance_residual")


def _alarms(rows: DataFrame, keys: list[str]) -> DataFrame:
    return drift_events.residual_alarms(rows, keys, ["idx"], "signed_error_sec", CFG)


_EVENT = ["scenario_id", "event_id", "drift_type", "severity", "detector", "window_start_idx", "window_end_idx"]


cte("cur_errors", "SELECT scenario_id, idx, timestamp_utc, actual - predicted AS signed_error_sec FROM cur_all", "cur_all")
cte("hinkley_scenario", _page_hinkley_sql("cur_errors", "scenario_id", CFG), "cur_errors")
cte("split_scenario", _split_window_sql("cur_errors", "scenario_id", sequential.SplitWindow.from_config(CFG)), "cur_errors")
cte("every_event", """SELECT *, window_end_idx - window_start_idx + 1 AS sample_count FROM all_events UNION ALL
  SELECT scenario_id, 'DRIFT_RES_' || scenario_id || printf('_%06d_', idx) || detector, 'CONCEPT_DRIFT', severity, detector, greatest(1, idx - 100), idx, statistic, NULL,
    'eta_to_next_stop_sec_residual', idx + 1 FROM (SELECT * FROM hinkley_scenario UNION ALL SELECT * FROM split_scenario) WHERE in_drift = 1""", "all_events", "hinkley_scenario", "split_scenario")


def window_events(rows: DataFrame, reference: DataFrame, shared: dict | None = None) -> DataFrame:
    """Data, performance and concept events per scenario."""
    results = judged(rows, reference, shared)
    bounds = drift_windows.pane_bounds(rows, ["scenario_id"])
    perf = drift_windows.performance_windows(rows, ["scenario_id"], CFG)
    alarms = _alarms(rows.select("scenario_id", "idx", "signed_error_sec"), ["scenario_id"])
    return drift_events.assemble(drift_events.data_events(results, bounds, ["scenario_id"], CFG),
                                 drift_events.performance_events(perf, ["scenario_id"], CFG),
                                 drift_events.concept_events(alarms, ["scenario_id"], CFG))


def _disturbed(current: DataFrame, scenario: whatif.Scenario) -> DataFrame:
    """Written once: every detector reads these rows, some of them several times."""
    rows = evaluation.with_errors(predict_again(whatif.scenario_rows(current, [scenario])), "actual", "predicted")
    return materialize(rows.select("scenario_id", "idx", "n", "timestamp_utc", "signed_error_sec", "absolute_error_sec", *FEATURES), "disturbed")


_SCENARIOS = ", ".join(f"('{x.scenario_id}', '{x.name}', {x.synthetic}, {x.intensity}::DOUBLE)" for x in whatif.CATALOG.values())


def _events_sql(scenario: str) -> str:
    return f"""SELECT {', '.join(_EVENT)}, {s6('statistic')} AS statistic, {s6('p_value')} AS p_value, affected_features, sample_count, timestamp_utc, scenario_name, synthetic_disturbance,
  disturbance_intensity, 'REPLAY' AS source_type, 'ridge' AS model_id, 'v1' AS model_version, 'OPEN' AS status
  FROM every_event JOIN (SELECT scenario_id, idx AS window_end_idx, timestamp_utc FROM cur_errors) USING (scenario_id, window_end_idx)
  JOIN (VALUES {_SCENARIOS}) c(scenario_id, scenario_name, synthetic_disturbance, disturbance_intensity) USING (scenario_id) WHERE scenario_id = '{scenario}'"""


def _described(spark, d, scenario: whatif.Scenario) -> DataFrame:
    reference, current = inputs(spark, d)
    rows = _disturbed(current, scenario)
    out = drift_events.described(window_events(rows, reference), rows, list(whatif.CATALOG.values()), "ridge", "v1")
    out = out.withColumns({"timestamp_utc": clean_time("timestamp_utc"), "affected_features": F.concat_ws(",", "affected_features")})
    return rounded(out.select(*_EVENT, "statistic", "p_value", "affected_features", "sample_count", "timestamp_utc", "scenario_name", "synthetic_disturbance",
                              "disturbance_intensity", "source_type", "model_id", "model_version", "status"), "statistic", "p_value")


@query("o17_drift_events", _events_sql("CONGESTION_SURGE"), ("every_event", "cur_errors"))
def events_of_surge(spark, d):
    return _described(spark, d, whatif.CONGESTION_SURGE)


@query("o17_all_kinds", _events_sql("COMBINED_DISRUPTION"), ("every_event", "cur_errors"))
def all_kinds(spark, d):
    """Data, performance and concept events of one disturbed stream."""
    return _described(spark, d, whatif.COMBINED_DISRUPTION)


@query("a09_drift_event_table", """SELECT drift_type, count(*) AS records FROM every_event WHERE scenario_id = 'HEAVY_RAIN' GROUP BY 1""", ("every_event",))
def drift_event_table(spark, d):
    from fleetlens.session import scratch_path
    from fleetlens.sources.writers import write_drift_events
    reference, current = inputs(spark, d)
    path = scratch_path(spark, "drift-events")
    write_drift_events(window_events(_disturbed(current, whatif.HEAVY_RAIN), reference), path)
    return spark.read.parquet(path).groupBy("drift_type").agg(F.count(F.lit(1)).alias("records"))


_SUMMARY = """SELECT scenario_id, count(*) AS total_alerts, count(*) FILTER (WHERE drift_type = 'DATA_DRIFT') AS data_drift_alerts,
  count(*) FILTER (WHERE drift_type = 'PERFORMANCE_DRIFT') AS performance_drift_alerts, count(*) FILTER (WHERE drift_type = 'CONCEPT_DRIFT') AS concept_drift_alerts,
  arg_min(window_end_idx, (window_end_idx, event_id)) AS first_detection_index, arg_min(drift_type, (window_end_idx, event_id)) AS first_detection_type,
  arg_min(detector, (window_end_idx, event_id)) AS first_detector_name,
  ['NONE', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(list_position(['NONE', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity))] AS max_severity
  FROM every_event"""


@query("o18_drift_summary", f"{_SUMMARY} WHERE scenario_id = 'HEAVY_RAIN' GROUP BY 1", ("every_event",))
def drift_summary(spark, d):
    reference, current = inputs(spark, d)
    return drift_events.summary(window_events(_disturbed(current, whatif.HEAVY_RAIN), reference), ["scenario_id"])


@query("o18_frequent_features", """SELECT feature, count(*) AS alerts FROM (SELECT unnest(string_split(affected_features, ',')) AS feature FROM every_event
  WHERE scenario_id = 'CONGESTION_SURGE' AND drift_type = 'DATA_DRIFT') GROUP BY 1 ORDER BY alerts DESC, feature LIMIT 10""", ("every_event",))
def frequent_features(spark, d):
    reference, current = inputs(spark, d)
    out = drift_events.frequent_features(window_events(_disturbed(current, whatif.CONGESTION_SURGE), reference), ["scenario_id"])
    return out.drop("scenario_id")


@query("o19_drift_status", """SELECT scenario_id, CAST(max(CASE drift_type WHEN 'DATA_DRIFT' THEN 1 ELSE 0 END) AS BIGINT) AS data_drift,
  CAST(max(CASE drift_type WHEN 'PERFORMANCE_DRIFT' THEN 1 ELSE 0 END) AS BIGINT) AS performance_drift, CAST(max(CASE drift_type WHEN 'CONCEPT_DRIFT' THEN 1 ELSE 0 END) AS BIGINT) AS concept_drift,
  max(window_end_idx) AS latest_event_idx, count(*) AS events FROM every_event WHERE scenario_id = 'ROAD_INCIDENT' GROUP BY 1""", ("every_event",))
def drift_status(spark, d):
    reference, current = inputs(spark, d)
    return drift_events.status(window_events(_disturbed(current, whatif.ROAD_INCIDENT), reference), ["scenario_id"])


@query("o20_feature_ranking", f"""SELECT feature, {s6('max(psi)')} AS max_psi, {s6('median(psi)')} AS median_psi, {s6('max(ks_statistic)')} AS max_ks,
  {s6('min(adjusted_p)')} AS min_p, {s6('max(js_distance)')} AS max_js, CAST(sum(CASE WHEN severity IN ('MEDIUM', 'HIGH', 'CRITICAL') THEN 1 ELSE 0 END) AS BIGINT)
  AS windows_flagged, count(*) AS windows FROM one_results GROUP BY 1""", ("one_results",))
def feature_ranking(spark, d):
    reference, current = inputs(spark, d)
    return rounded(drift_detect.feature_ranking(all_results(one_scenario(current), reference)), "max_psi", "median_psi", "max_ks", "min_p", "max_js")


@query("o21_scenario_drift", f"{_SUMMARY} GROUP BY 1", ("every_event",))
def scenario_drift(spark, d):
    """All scenarios in one job; the scenario leads every key."""
    reference, current = inputs(spark, d)
    rows = evaluation.with_errors(predict_again(whatif.scenario_rows(current)), "actual", "predicted")
    shared = whatif.shared_columns(FEATURES)
    rows = whatif.without_copies(rows.select("scenario_id", "idx", "n", "signed_error_sec", "absolute_error_sec", *FEATURES), shared)
    return drift_events.summary(window_events(materialize(rows, "disturbed"), reference, shared), ["scenario_id"])
