"""Reference profiles and distribution distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.columns import melt
from fleetlens.functions.stats import exact_kolmogorov_p, kolmogorov_p
from fleetlens.ordering import OrderBlocks, Ordered, order_blocks
from fleetlens.quantiles import cumulative_counts, exact_quantiles, summarize

BINS = 10
EXACT_SAMPLES = 10_000
POINT_MASS_SHARE = 0.25
POINT_MASS_PAD = 1e-4


def numeric_profile(long: DataFrame, bins: int = BINS, blocks: OrderBlocks | None = None) -> DataFrame:
    """Reference profile per feature of (feature, value) rows, with bin edges.

    Edges are distinct deciles.  When at least a quarter of the values equal the
    minimum, that point gets its own bin and the rest is cut at ``bins`` percentile points.
    """
    known = long.filter(F.col("value").isNotNull())
    blocks = blocks or order_blocks(known.select("value"), "value")
    by_value = {"value": blocks}
    deciles = {f"_d{i:03d}": ("value", i / bins) for i in range(bins + 1)}
    stats = summarize(known, ["feature"], {
        "sample_count": F.count("value"), "mean": F.avg("value"), "std": F.stddev_pop("value"),
        "min": F.min("value"), "max": F.max("value"),
    }, {"q25": ("value", 0.25), "median": ("value", 0.5), "q75": ("value", 0.75), **deciles}, by_value)
    missing = long.groupBy("feature").agg(F.count_if(F.col("value").isNull()).alias("missing_count"),
                                          F.count(F.lit(1)).alias("_all"))
    low = stats.select("feature", F.col("min").alias("_low"))
    marked = known.join(low, "feature").withColumn("_above", F.when(F.col("value") > F.col("_low"), F.col("value")))
    mass = marked.groupBy("feature").agg(
        F.count_if(F.col("_above").isNull()).alias("_at_min"), F.count("_above").alias("_above_min"))
    rest = {f"_r{i:03d}": i / (bins - 1) for i in range(bins)}
    above = exact_quantiles(marked.filter(F.col("_above").isNotNull()).select("feature", F.col("_above").alias("value")),
                            ["feature"], "value", rest, blocks)
    joined = stats.join(missing, "feature").join(mass, "feature").join(above, "feature", "left")

    plain = F.array_distinct(F.array(*[F.col(c) for c in deciles]))
    widened = F.array(F.col("min") - 1e-3, F.col("max") + 1e-3)
    massed = F.array_sort(F.array_distinct(F.concat(
        F.array(F.col("min") - POINT_MASS_PAD, F.col("min") + POINT_MASS_PAD), F.array(*[F.col(c) for c in rest]))))
    edges = (
        F.when((F.col("_at_min") >= POINT_MASS_SHARE * F.col("sample_count")) & (F.col("_above_min") > 0), massed)
        .when(F.col("_at_min") >= POINT_MASS_SHARE * F.col("sample_count"), F.array(F.col("min") - 1.0, F.col("min") + 1.0))
        .when(F.size(plain) < 2, widened).otherwise(plain))
    return joined.select(
        "feature", "sample_count", "missing_count", (F.col("missing_count") / F.col("_all")).alias("missing_rate"),
        "mean", "std", "min", "q25", "median", "q75", "max", edges.alias("bin_edges"))


def categorical_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Category frequencies as (feature, category, records) rows."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "feature", "category")
    return long.filter(F.col("category").isNotNull()).groupBy("feature", "category").agg(F.count(F.lit(1)).alias("records"))


def bin_number(value: Column, edges: Column, bins: int = BINS) -> Column:
    """0-based bin with open ends: left-closed bins between the inner edges.

    A profile has at most ``bins`` + 2 edges, so the search is written out as
    comparisons, which stay inside generated code.
    """
    most = bins + 2
    number = F.lit(0)
    for i in range(1, most - 1):
        inner = F.lit(i) < F.size(edges) - 1
        number = number + F.when(inner & (F.get(edges, F.lit(i)) <= value), 1).otherwise(0)
    return F.when(F.size(edges) <= most, number).otherwise(F.raise_error(F.lit("profile has more edges than bins allow")))


def binned_counts(long: DataFrame, profile: DataFrame, keys: Sequence[str] = (), weight: str | None = None,
                  bins: int = BINS) -> DataFrame:
    """Rows (or summed weights) per (keys, feature, bin), only bins that occur."""
    edges = profile.select("feature", "bin_edges")
    rows = long.filter(F.col("value").isNotNull()).join(edges, "feature")
    return rows.groupBy(*keys, "feature", bin_number(F.col("value"), F.col("bin_edges"), bins).alias("bin")).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("records"))


def bin_grid(profile: DataFrame) -> DataFrame:
    """Every bin of every feature; empty bins must take part in the distances."""
    return profile.select("feature", F.size("bin_edges").alias("_e"),
                          F.explode(F.sequence(F.lit(0), F.size("bin_edges") - 2)).alias("bin")).select(
        "feature", (F.col("_e") - 1).alias("bins"), "bin")


def binned_distances(reference: DataFrame, current: DataFrame, profile: DataFrame, keys: Sequence[str] = (),
                     components: bool = False) -> DataFrame:
    """PSI (add-one smoothing) and Jensen-Shannon distance per (keys, feature).

    Both inputs are bin counts.  ``components`` returns one row per bin instead.
    """
    grid = bin_grid(profile)
    ref = grid.join(reference.select("feature", "bin", F.col("records").alias("_r")), ["feature", "bin"], "left")
    groups = current.select(*keys, "feature").distinct()
    full = groups.join(ref, "feature").join(
        current.select(*keys, "feature", "bin", F.col("records").alias("_c")), [*keys, "feature", "bin"], "left"
    ).fillna(0, ["_r", "_c"])
    per = Window.partitionBy(*keys, "feature")
    n_r, n_c, k = F.sum("_r").over(per), F.sum("_c").over(per), F.col("bins")
    floor = 1e-5
    shares = full.withColumns({
        "ref_share": (F.col("_r") + 1.0) / (n_r + k), "cur_share": (F.col("_c") + 1.0) / (n_c + k),
        "_p": F.greatest(F.col("_r") / F.greatest(n_r, F.lit(1)), F.lit(floor)),
        "_q": F.greatest(F.col("_c") / F.greatest(n_c, F.lit(1)), F.lit(floor)),
    })
    part = (F.col("cur_share") - F.col("ref_share")) * F.ln(F.col("cur_share") / F.col("ref_share"))
    scored = shares.withColumns({
        "psi_component": part, "_p": F.col("_p") / F.sum("_p").over(per), "_q": F.col("_q") / F.sum("_q").over(per)})
    if components:
        return scored.select(*keys, "feature", "bin", F.col("_r").alias("ref_count"), F.col("_c").alias("cur_count"),
                             "ref_share", "cur_share", "psi_component")
    m = (F.col("_p") + F.col("_q")) / 2
    js = (F.sum(F.col("_p") * F.log2(F.col("_p") / m)) + F.sum(F.col("_q") * F.log2(F.col("_q") / m))) / 2
    return scored.groupBy(*keys, "feature").agg(
        F.greatest(F.sum("psi_component"), F.lit(0.0)).alias("psi"),
        F.least(F.sqrt(F.greatest(js, F.lit(0.0))), F.lit(1.0)).alias("js_distance"))


def ks_two_sample(reference: DataFrame, current: DataFrame, keys: Sequence[str] = ("feature",),
                  blocks: OrderBlocks | None = None) -> DataFrame:
    """KS statistic, asymptotic p-value and Wasserstein-1 distance of two (keys, value) tables."""
    both = reference.select(*keys, "value", F.lit(1).alias("_r"), F.lit(0).alias("_c")).unionByName(
        current.select(*keys, "value", F.lit(0).alias("_r"), F.lit(1).alias("_c"))).filter(F.col("value").isNotNull())
    cum = cumulative_counts(both, list(keys), "value", {"r": F.col("_r"), "c": F.col("_c")}, blocks)
    gap = F.abs(F.col("cum_r") / F.col("all_r") - F.col("cum_c") / F.col("all_c"))
    out = cum.filter((F.col("all_r") > 0) & (F.col("all_c") > 0)).groupBy(*keys).agg(
        F.max(gap).alias("ks_statistic"),
        F.coalesce(F.sum(gap * (F.col("next_value") - F.col("value"))), F.lit(0.0)).alias("wasserstein"),
        F.max("all_r").alias("reference_count"), F.max("all_c").alias("current_count"))
    return out.withColumn("p_value", kolmogorov_p(F.col("ks_statistic"), F.col("reference_count"), F.col("current_count")))


def with_exact_p(tests: DataFrame, most: int = EXACT_SAMPLES) -> DataFrame:
    """Exact p-values of KS tests whose samples both have at most ``most`` values; larger samples keep the asymptotic ones.

    Tests are few bytes for their work, so they are dealt over all cores, equal ones to the same task, which counts their paths once.
    """
    small = F.greatest("reference_count", "current_count") <= most
    case = F.round(F.col("ks_statistic") * F.col("reference_count") * F.col("current_count"))
    tests = tests.repartition(4 * tests.sparkSession.sparkContext.defaultParallelism, case, "reference_count", "current_count")
    n1, n2 = (F.when(small, F.col(c)) for c in ("reference_count", "current_count"))  # null: not computed
    return tests.withColumn("p_value", F.coalesce(exact_kolmogorov_p(F.col("ks_statistic"), n1, n2), F.col("p_value")))


def reference_ranks(reference: DataFrame, values: DataFrame, blocks: OrderBlocks | None = None) -> DataFrame:
    """For each distinct (feature, value): reference rows at, through, and in all.

    One ordered pass over the reference, whatever the number of windows.
    """
    both = reference.select("feature", "value", F.lit(1).alias("_r")).unionByName(
        values.select("feature", "value", F.lit(0).alias("_r")))
    counted = both.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.sum("_r").alias("ref_at"), F.count_if(F.col("_r") == 0).alias("_wanted"))
    ranked = Ordered(counted, ["feature"], ["value"], blocks or order_blocks(reference.select("value"), "value")
                     ).running_sum("ref_at", "ref_through").total("sum", "ref_at", "ref_all").frame()
    return ranked.filter(F.col("_wanted") > 0).drop("_wanted")


def ks_from_ranks(steps: DataFrame, per: Sequence[str], weight: str) -> DataFrame:
    """KS per group from its values, their weights and their places in the reference.

    The group's steps are its own values, so the largest gap lies at one of them,
    from the left or from the right; the reference is looked up there, not copied
    into every group.
    """
    group = Window.partitionBy(*per)
    ordered = group.orderBy("value")
    equal = ordered.rangeBetween(Window.currentRow, Window.currentRow)
    placed = steps.withColumns({
        "_through": F.sum(weight).over(ordered), "_at": F.sum(weight).over(equal), "_n": F.sum(weight).over(group)})
    right = F.abs(F.col("_through") / F.col("_n") - F.col("ref_through") / F.col("ref_all"))
    left = F.abs((F.col("_through") - F.col("_at")) / F.col("_n")
                 - (F.col("ref_through") - F.col("ref_at")) / F.col("ref_all"))
    out = placed.groupBy(*per).agg(F.max(F.greatest(right, left)).alias("ks_statistic"),
                                   F.max("_n").alias("current_count"), F.max("ref_all").alias("reference_count"))
    return out.withColumn("p_value", kolmogorov_p(F.col("ks_statistic"), F.col("reference_count"), F.col("current_count")))


def windowed_ks(reference: DataFrame, current: DataFrame, keys: Sequence[str] = ("window_id",),
                blocks: OrderBlocks | None = None) -> DataFrame:
    """KS of every window of (keys, feature, value) rows against one large reference."""
    known = current.filter(F.col("value").isNotNull())
    per = [*keys, "feature"]
    steps = known.groupBy(*per, "value").agg(F.count(F.lit(1)).alias("records"))
    return ks_from_ranks(steps.join(reference_ranks(reference, steps, blocks), ["feature", "value"]), per, "records")


def benjamini_hochberg(df: DataFrame, keys: Sequence[str], p: str = "p_value", alpha: float = 0.05,
                       tie: str = "feature") -> DataFrame:
    """Adjusted p-values and rejections within each key (a few tests per key)."""
    group = Window.partitionBy(*keys)
    ordered = group.orderBy(p, tie)
    scaled = F.col(p) * F.count(F.lit(1)).over(group) / F.row_number().over(ordered)
    step_up = F.min("_scaled").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("_scaled", scaled).withColumn(
        "adjusted_p", F.least(F.greatest(step_up, F.lit(0.0)), F.lit(1.0))).drop("_scaled").withColumn(
        "rejected", F.when(F.col("adjusted_p") <= alpha, 1).otherwise(0).cast("long"))


def categorical_psi(reference: DataFrame, current: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """PSI over the union of categories, shares floored at 1e-4 and renormalised.

    Reference categories a window lacks enter through totals of the reference
    (count, sum p, sum ln p, sum p ln p), so a large vocabulary is not repeated
    for every window.
    """
    floor = 1e-4
    total = F.sum("records").over(Window.partitionBy("feature"))
    p_ref = reference.select("feature", "category",
                             F.greatest(F.col("records") / total, F.lit(floor)).alias("_p"))
    p = F.col("_p")
    totals = p_ref.groupBy("feature").agg(F.count(F.lit(1)).alias("_k"), F.sum(p).alias("_A"),
                                          F.sum(F.ln(p)).alias("_B"), F.sum(p * F.ln(p)).alias("_C"))
    sizes = current.groupBy(*keys, "feature").agg(F.sum("records").alias("_n"))
    seen = current.join(sizes, [*keys, "feature"]).join(p_ref, ["feature", "category"], "left")
    known = p.isNotNull()
    q = F.greatest(F.col("records") / F.col("_n"), F.lit(floor))
    own = F.coalesce(p, F.lit(floor))
    zero = F.lit(0.0)
    sums = seen.groupBy(*keys, "feature").agg(
        F.count_if(known).alias("m"), F.count_if(~known).alias("new"),
        F.sum(F.when(known, p).otherwise(zero)).alias("mA"),
        F.sum(F.when(known, F.ln(p)).otherwise(zero)).alias("mB"),
        F.sum(F.when(known, p * F.ln(p)).otherwise(zero)).alias("mC"),
        F.sum(q).alias("Q"), F.sum(own).alias("P"),
        F.sum(q * F.ln(q)).alias("QlQ"), F.sum(q * F.ln(own)).alias("QlP"),
        F.sum(own * F.ln(q)).alias("PlQ"), F.sum(own * F.ln(own)).alias("PlP"),
    ).join(totals, "feature")
    c = F.col
    absent = c("_k") - c("m")
    scaled = sums.withColumns({"Sp": c("_A") + c("new") * floor, "Sq": c("Q") + absent * floor})
    shift = F.ln(c("Sp")) - F.ln(c("Sq"))
    present = ((c("QlQ") - c("QlP") + c("Q") * shift) / c("Sq")) - ((c("PlQ") - c("PlP") + c("P") * shift) / c("Sp"))
    q0 = F.lit(floor) / c("Sq")
    lead = F.ln(q0) + F.ln(c("Sp"))
    missing = (absent * q0 * lead - q0 * (c("_B") - c("mB"))
               - lead * (c("_A") - c("mA")) / c("Sp") + (c("_C") - c("mC")) / c("Sp"))
    return scaled.select(*keys, "feature", F.greatest(present + missing, zero).alias("psi"),
                         (c("_k") + c("new")).alias("categories"))


def feature_rows(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Numeric features as (ids, feature, value) rows."""
    return melt(df, list(ids), list(features))
