"""Chronological splits, candidate training sets and their provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.stats import row_digest
from fleetlens.operators.topology import overlap, union_common
from fleetlens.ordering import OrderBlocks, with_index
from fleetlens.schemas import TARGET

RATIOS = (("train", 0.70), ("validation", 0.15), ("stream", 0.15))


def chronological_split(df: DataFrame, order: Sequence[str], ratios=RATIOS,
                        blocks: OrderBlocks | None = None) -> DataFrame:
    """Label rows train/validation/stream by their place in time.

    Boundaries are floor(n * cumulative share); the last part takes the rest.
    """
    placed = with_index(df, list(order), "_idx", "_n", blocks)
    label: Column = F.lit(ratios[-1][0])
    share = 0.0
    bounds = []
    for name, ratio in ratios[:-1]:
        share += ratio
        bounds.append((name, share))
    for name, share in reversed(bounds):
        label = F.when(F.col("_idx") < F.floor(F.col("_n") * F.lit(share)), name).otherwise(label)
    return placed.withColumn("split", label).drop("_idx", "_n")


def split_report(df: DataFrame, ts: str, trip: str, device: str) -> DataFrame:
    """Rows, share, time range and uniques per split."""
    per = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("records"), F.min(ts).alias("start_time_utc"), F.max(ts).alias("end_time_utc"),
        F.count_distinct(trip).alias("unique_trips"), F.count_distinct(device).alias("unique_devices"))
    total = per.agg(F.sum("records")).scalar()
    return per.withColumn("percentage", F.col("records") * 100.0 / total)


def head_and_holdout(df: DataFrame, order: Sequence[str], share: float = 0.8,
                     blocks: OrderBlocks | None = None) -> DataFrame:
    """Earlier part for training, later part held out; both get at least one row."""
    placed = with_index(df, list(order), "_idx", "_n", blocks)
    cut = F.least(F.greatest(F.floor(F.col("_n") * F.lit(share)), F.lit(1)), F.col("_n") - 1)
    return placed.withColumn("part", F.when(F.col("_idx") < cut, "train").otherwise("holdout")).drop("_idx", "_n")


def with_target(df: DataFrame, fallback: str = "actual_eta_sec") -> DataFrame:
    """Use the outcome column as the label where the label column is absent."""
    if TARGET in df.columns or fallback not in df.columns:
        return df
    return df.withColumn(TARGET, F.col(fallback))


def candidate_dataset(history: DataFrame, stream: DataFrame, order: Sequence[str], share: float = 0.8,
                      blocks: OrderBlocks | None = None) -> tuple[DataFrame, DataFrame]:
    """(training rows, recent holdout): history plus the head of the stream, and its tail."""
    parts = head_and_holdout(with_target(stream), order, share, blocks)
    head = parts.filter(F.col("part") == "train").drop("part")
    tail = parts.filter(F.col("part") == "holdout").drop("part")
    return union_common(history, head), tail


def table_hash(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free content hash: row count and the sum of the leading 60 bits of row digests."""
    digest = row_digest([F.col(c) for c in (columns or df.columns)])
    lead = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(lead.alias("h")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum("h"), F.lit(0).cast("decimal(38,0)")).cast("string").alias("content_hash"))


def provenance(train: DataFrame, original_holdout: DataFrame, recent_holdout: DataFrame,
               keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One manifest row: sizes, content hashes and the disjointness check."""
    def hashed(df: DataFrame) -> Column:
        return table_hash(df, columns).select(F.struct("row_count", "content_hash")).scalar()

    checks = overlap(train, original_holdout.select(*keys).unionByName(recent_holdout.select(*keys)), keys)
    row = table_hash(train, columns).select(F.col("row_count").alias("train_rows"), F.col("content_hash").alias("train_hash"))
    for prefix, df in (("original_holdout", original_holdout), ("recent_holdout", recent_holdout)):
        side = hashed(df)
        row = row.withColumns({f"{prefix}_rows": side.getField("row_count"), f"{prefix}_hash": side.getField("content_hash")})
    check = checks.select(F.struct("shared_rows", "is_disjoint")).scalar()
    total = F.col("train_rows") + F.col("recent_holdout_rows")
    return row.withColumns({"shared_rows": check.getField("shared_rows"), "is_disjoint": check.getField("is_disjoint"),
                            "holdout_share": F.col("recent_holdout_rows") / total})
