"""Exact quantiles and rank lookups without a group's values in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.ordering import BLOCK, Ordered, OrderBlocks, order_blocks
from fleetlens.session import materialize


def exact_quantiles(df: DataFrame, keys: list[str], column: str, named: dict[str, float],
                    blocks: OrderBlocks | None = None) -> DataFrame:
    """Linear-interpolated quantiles per key as columns, nulls left out.

    Block totals, one row per (key, block) and task, find the few blocks that hold
    the wanted ranks; only the values of those are counted, shuffled and sorted.
    """
    values = df.filter(F.col(column).isNotNull())
    blocks = blocks or order_blocks(values.select(column), column)
    if blocks.single:
        probs = F.array(*[F.lit(float(p)) for p in named.values()])
        grouped = values.groupBy(*keys).agg(F.percentile(F.col(column), probs).alias("_q"))
        return grouped.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(named)])

    tagged = blocks.tag(values.select(*keys, F.col(column).alias(blocks.column)))
    value = F.col(blocks.column)
    part = [*keys, BLOCK]
    per_block = tagged.groupBy(*part).agg(F.count(F.lit(1)).alias("_bc"))
    key = Window.partitionBy(*keys)
    offsets = per_block.select(
        *part,
        "_bc",
        (F.sum("_bc").over(key.orderBy(BLOCK)) - F.col("_bc")).alias("_off"),
        F.sum("_bc").over(key).alias("_n"),
    )
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in named.items()]))
    exact = F.col("w.p") * (F.col("_n") - 1)
    targets = (
        offsets.select("*", wanted.alias("w"))
        .select(*part, "_bc", "_off", F.col("w.name").alias("_name"), (exact - F.floor(exact)).alias("_t"),
                F.floor(exact).alias("_lo"), F.ceil(exact).alias("_hi"))
        .filter((F.col("_lo") < F.col("_off") + F.col("_bc")) & (F.col("_hi") >= F.col("_off")))
    )
    targets = materialize(targets, "quantile-ranks")  # a few rows per key: stored, their size is known, and no other value is shuffled
    counted = tagged.join(targets.select(*part).distinct(), part, "left_semi").groupBy(*part, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = (
        counted
        .withColumn("_cum", F.sum("_c").over(Window.partitionBy(*part).orderBy(value)))
        .join(targets, part)
        .withColumn("_from", F.col("_off") + F.col("_cum") - F.col("_c"))
        .withColumn("_to", F.col("_off") + F.col("_cum"))
    )

    def at(rank: str) -> Column:
        return F.max(F.when((F.col(rank) >= F.col("_from")) & (F.col(rank) < F.col("_to")), value))

    points = ranked.groupBy(*keys, "_name").agg(at("_lo").alias("_a"), at("_hi").alias("_b"), F.max("_t").alias("_t"))
    lerp = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t")
    return points.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, lerp)).alias(n) for n in named])


def summarize(df: DataFrame, keys: list[str], aggregates: dict[str, Column],
              quantiles: dict[str, tuple[str, float]], blocks: dict[str, OrderBlocks] | None = None) -> DataFrame:
    """Aggregates plus exact quantiles of several columns, one row per key.

    ``quantiles`` maps an output name to (column, share).  Small inputs take one
    aggregation; otherwise each quantile column is selected by rank and joined on
    the keys, which by then are one row per group.
    """
    columns = sorted({c for c, _ in quantiles.values()})
    blocks = dict(blocks or {})
    if columns and not blocks:
        first = order_blocks(df.select(columns[0]), columns[0])
        blocks[columns[0]] = first
        for c in columns[1:]:
            blocks[c] = OrderBlocks(c) if first.single else order_blocks(df.select(c), c)
    if all(blocks[c].single for c in columns):
        # one percentile buffer per column, whatever the number of quantiles
        shares = {c: sorted({p for col, p in quantiles.values() if col == c}) for c in columns}
        packed = [F.percentile(F.col(c), F.array(*[F.lit(float(p)) for p in ps])).alias(f"_q_{c}") for c, ps in shares.items()]
        out = df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggregates.items()], *packed)
        return out.select(*keys, *aggregates, *[
            F.col(f"_q_{c}")[shares[c].index(p)].alias(n) for n, (c, p) in quantiles.items()])

    work, on = (df, keys) if keys else (df.withColumn("_all", F.lit(1)), ["_all"])
    out = work.groupBy(*on).agg(*[e.alias(n) for n, e in aggregates.items()]) if aggregates else None
    for c in columns:
        named = {n: p for n, (col, p) in quantiles.items() if col == c}
        q = exact_quantiles(work, on, c, named, blocks[c])
        if out is None:
            out = q
        else:
            renamed = q.select(*[F.col(k).alias(f"_k_{k}") for k in on], *named)
            match = None
            for k in on:
                same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
                match = same if match is None else match & same
            out = out.join(renamed, match, "left").drop(*[f"_k_{k}" for k in on])
    return out.select(*keys, *aggregates, *quantiles)


def cumulative_counts(df: DataFrame, keys: list[str], column: str, weights: dict[str, Column],
                      blocks: OrderBlocks | None = None) -> DataFrame:
    """Per distinct value: weight at the value, cumulative weight through it and the key's total.

    For every name in ``weights`` the columns ``name``, ``cum_name`` and
    ``all_name`` result; ``next_value`` is the next distinct value of the key.
    """
    counted = df.groupBy(*keys, column).agg(*[F.sum(w).alias(n) for n, w in weights.items()])
    seq = Ordered(counted, keys, [column], blocks or order_blocks(df.select(column), column))
    for n in weights:
        seq = seq.running_sum(n, f"cum_{n}").total("sum", n, f"all_{n}")
    return seq.lead(column, "next_value").frame()


def kth_of_prefixes(ranks: np.ndarray, weights: np.ndarray, ends: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each (end, k): the least rank r such that the first ``end`` elements have more than k weight at ranks up to r.

    The elements are parted by one bit of their rank after the other, from the top, in stable order (a wavelet matrix); a prefix is a
    range on every level, so all prefixes go down together, in (elements + prefixes) * bits.
    """
    low, high, found, k = np.zeros(len(ends), np.int64), ends.astype(np.int64), np.zeros(len(ends), np.int64), k.astype(np.int64)
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        one = (ranks >> bit) & 1 == 1
        zeros, light = np.r_[0, np.cumsum(~one)], np.r_[0, np.cumsum(np.where(one, 0, weights))]
        below = light[high] - light[low]
        up = k >= below
        found |= up.astype(np.int64) << bit
        k = np.where(up, k - below, k)
        low, high = (np.where(up, zeros[-1] + at - zeros[at], zeros[at]) for at in (low, high))
        ranks, weights = (np.concatenate([x[~one], x[one]]) for x in (ranks, weights))
    return found


def prefix_quantiles(df: DataFrame, column: str, named: dict[str, float], blocks: OrderBlocks | None = None) -> DataFrame:
    """Exact quantiles of the growing prefixes ``_first`` .. ``_last`` of a stepped table.

    Rows carry ``_step`` and the constants ``_first`` and ``_last``; prefix s holds
    the rows with ``_step`` <= s that have a value.  Equal values of a step are counted first. Running counts per value block
    tell which block holds a wanted rank of a prefix; within a block all wanted ranks of all prefixes are found together.
    """
    blocks = blocks or order_blocks(df.select(column), column)
    at = F.greatest(F.col("_step"), F.col("_first"))
    tagged = blocks.tag(df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias(column), at.alias("_step"), "_first", "_last"))
    counted = materialize(tagged.groupBy(BLOCK, column, "_step").agg(F.count(F.lit(1)).alias("_c"), F.min("_first").alias("_first"), F.max("_last").alias("_last")), "counted-values")

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_step")
        steps = np.arange(int(rows["_first"].iloc[0]), int(rows["_last"].iloc[0]) + 1)
        total = np.r_[0, np.cumsum(rows["_c"].to_numpy())][np.searchsorted(rows["_step"].to_numpy(), steps, "right")]
        return pd.DataFrame({"_s": steps, BLOCK: rows[BLOCK].iloc[0], "_bc": total})

    block_type = counted.schema[BLOCK].dataType.simpleString()
    grown = counted.groupBy(BLOCK).applyInPandas(grow, f"_s long, {BLOCK} {block_type}, _bc long")
    prefix = Window.partitionBy("_s")
    offsets = grown.withColumns({
        "_off": F.sum("_bc").over(prefix.orderBy(BLOCK)) - F.col("_bc"), "_n": F.sum("_bc").over(prefix)})
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in named.items()]))
    exact = F.col("w.p") * (F.col("_n") - 1)
    ends = F.explode(F.array(F.struct(F.lit("a").alias("end"), F.floor(exact).alias("rank")), F.struct(F.lit("b").alias("end"), F.ceil(exact).alias("rank"))))
    targets = offsets.select("*", wanted.alias("w")).select("_s", BLOCK, "_bc", "_off", F.col("w.name").alias("_name"), (exact - F.floor(exact)).alias("_t"), ends.alias("_r"))
    targets = targets.select("_s", BLOCK, "_name", "_t", F.col("_r.end").alias("_end"), (F.col("_r.rank") - F.col("_off")).alias("_k"), "_bc").filter("_k >= 0 and _k < _bc").drop("_bc")

    def pick(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_step")
        values, ranks = np.unique(rows[column].to_numpy(), return_inverse=True)
        ends = np.searchsorted(rows["_step"].to_numpy(), asked["_s"].to_numpy(), "right")
        found = kth_of_prefixes(ranks, rows["_c"].to_numpy(), ends, asked["_k"].to_numpy())
        return asked[["_s", "_name", "_t", "_end"]].assign(_v=values[found] if len(values) else np.nan)

    points = targets.groupBy(BLOCK).cogroup(counted.groupBy(BLOCK)).applyInPandas(pick, "_s long, _name string, _t double, _end string, _v double")
    point = points.groupBy("_s", "_name").agg(F.max(F.when(F.col("_end") == "a", F.col("_v"))).alias("_a"), F.max(F.when(F.col("_end") == "b", F.col("_v"))).alias("_b"), F.max("_t").alias("_t"))
    lerp = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t")
    return point.groupBy(F.col("_s").alias("_step")).agg(*[F.max(F.when(F.col("_name") == n, lerp)).alias(n) for n in named])
