"""Queries over the model transition log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.ordering import Ordered, OrderBlocks

# fixed values: permitted status changes
ALLOWED = {
    "CANDIDATE": ["VALIDATED", "REJECTED"],
    "VALIDATED": ["SHADOW", "REJECTED"],
    "SHADOW": ["CANARY_10", "REJECTED"],
    "CANARY_10": ["CANARY_50", "REJECTED"],
    "CANARY_50": ["PROMOTION_CANDIDATE", "REJECTED"],
    "PROMOTION_CANDIDATE": ["PRODUCTION", "REJECTED"],
    "PRODUCTION": ["ARCHIVED", "ROLLED_BACK"],
    "REJECTED": [],
    "ROLLED_BACK": [],
    "ARCHIVED": ["PRODUCTION"],
}


def is_allowed(before: Column, after: Column) -> Column:
    """A first entry must be CANDIDATE; later ones must follow the table."""
    legal = F.lit(False)
    for status, nexts in ALLOWED.items():
        if nexts:
            legal = legal | ((before == status) & after.isin(nexts))
    return F.when(before.isNull(), after == "CANDIDATE").otherwise(legal)


def check_transitions(log: DataFrame, order: Sequence[str], blocks: OrderBlocks | None = None) -> DataFrame:
    """Previous status and legality of every log row."""
    seq = Ordered(log, ["model_id"], list(order), blocks).lag("to_status", 1, "from_status").row_number("step").frame()
    return seq.withColumn("is_legal", F.when(is_allowed(F.col("from_status"), F.col("to_status")), 1).otherwise(0).cast("long"))


def current_status(log: DataFrame, order: Sequence[str]) -> DataFrame:
    return log.groupBy("model_id").agg(
        F.max_by(F.struct("to_status", *order), F.struct(*order)).alias("s"), F.count(F.lit(1)).alias("transitions")
    ).select("model_id", F.col("s.to_status").alias("status"), *[F.col(f"s.{c}").alias(c) for c in order], "transitions")


def production_model(status: DataFrame, preferred: str | None = None, order: Sequence[str] = ("model_id",)) -> DataFrame:
    """The preferred model if it is in production, else the first production model."""
    live = status.filter(F.col("status") == "PRODUCTION")
    wanted = F.when(F.col("model_id") == F.lit(preferred), 0).otherwise(1) if preferred else F.lit(0)
    return live.orderBy(wanted, *order).limit(1)


def production_counts(checked: DataFrame, order: Sequence[str], blocks: OrderBlocks | None = None) -> DataFrame:
    """Number of production models after every log row; legal states have exactly one."""
    change = F.when(F.col("to_status") == "PRODUCTION", 1).otherwise(0) - F.when(
        F.col("from_status") == "PRODUCTION", 1).otherwise(0)
    steps = checked.withColumn("_change", change)
    return Ordered(steps, [], list(order), blocks).running_sum("_change", "in_production").frame().drop("_change")


def rollback_targets(status: DataFrame, models: DataFrame, default: str) -> DataFrame:
    """For each production model the parent to restore, with the parent's status."""
    live = status.filter(F.col("status") == "PRODUCTION").join(models, "model_id", "left")
    target = live.select("model_id", F.coalesce("parent_model_id", F.lit(default)).alias("rollback_to"))
    parents = status.select(F.col("model_id").alias("rollback_to"), F.col("status").alias("target_status"))
    return target.join(parents, "rollback_to", "left")


def latest_non_production(status: DataFrame, order: Sequence[str]) -> DataFrame:
    return status.filter(F.col("status") != "PRODUCTION").orderBy(*[F.desc(c) for c in order]).limit(1)


def transition_audit(checked: DataFrame) -> DataFrame:
    return checked.groupBy("to_status").agg(
        F.count_if(F.col("is_legal") == 1).alias("accepted"), F.count_if(F.col("is_legal") == 0).alias("rejected"))
