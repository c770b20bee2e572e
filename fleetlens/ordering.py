"""Ordered computations that do not put a whole key into one task.

A window partitioned by a key alone sends every row of a hot key to one task.
Here the order column is cut into blocks of bounded size, the window runs per
(key, block), and one small row per (key, block) carries what the later blocks
need: counts, sums, the last values and the next first value.  The result is
the same as that of the plain window.  Only keys of more rows than a block are
cut; all others take the plain window, which shuffles their rows once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS_CONF = "spark.fleetlens.blockRows"
BLOCK_ROWS = 1_000_000
BLOCK = "_block"


def block_rows(spark) -> int:
    return int(spark.conf.get(BLOCK_ROWS_CONF, str(BLOCK_ROWS)))


def _ordinal(df: DataFrame, column: str) -> Column:
    """The order column as a number; nulls sort first, as in ORDER BY."""
    kind = df.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        value = F.unix_micros(value.cast("timestamp"))
    return F.coalesce(value.cast("double"), F.lit(float("-inf")))


@dataclass(frozen=True)
class OrderBlocks:
    """Cut points of an order column.  They balance load only; results do not depend on them.

    ``rows`` is what a block may hold, ``short`` the key sets known to have no key of more rows.
    """

    column: str
    cuts: tuple[float, ...] = ()
    rows: int = BLOCK_ROWS
    short: tuple[frozenset[str], ...] = field(default=(), compare=False)

    @property
    def single(self) -> bool:
        return not self.cuts

    def fits(self, keys: Sequence[str]) -> bool:
        """Whether no key has more rows than a block; keys that add columns to such keys have none either."""
        return self.single or any(known <= set(keys) for known in self.short)

    def settle(self, df: DataFrame, keys: Sequence[str]) -> "OrderBlocks":
        """Note whether every key of a frame fits a block, so that later passes over its rows need not ask again."""
        if self.fits(keys):
            return self
        rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows")).first()[0]
        return replace(self, short=(*self.short, frozenset(keys))) if (rows or 0) <= self.rows else self

    def tag(self, df: DataFrame, out: str = BLOCK) -> DataFrame:
        """Add the block number of every row; a pure function of the row, so retries agree."""
        if self.single:
            return df.withColumn(out, F.lit(0))
        splits = [float("-inf"), *self.cuts, float("inf")]
        tagged = Bucketizer(splits=splits, inputCol="_ordinal", outputCol=out).transform(
            df.withColumn("_ordinal", _ordinal(df, self.column))
        )
        return tagged.withColumn(out, F.col(out).cast("int")).drop("_ordinal")


def order_blocks(df: DataFrame, column: str, rows_per_block: int | None = None) -> OrderBlocks:
    """Choose cut points from approximate quantiles of the order column.

    The driver receives one number per block.  A table that fits one block is
    only counted.
    """
    per_block = rows_per_block or block_rows(df.sparkSession)
    total = df.count()
    blocks = -(-total // per_block)
    if blocks <= 1:
        return OrderBlocks(column, rows=per_block)
    shares = [i / blocks for i in range(1, blocks)]
    row = df.agg(
        F.percentile_approx(_ordinal(df, column), shares, max(10_000, 10 * blocks)).alias("cuts")
    ).first()
    finite = sorted({c for c in row["cuts"] if c not in (float("-inf"), float("inf"))})
    return OrderBlocks(column, tuple(finite), per_block)


def small_like(blocks: OrderBlocks, *columns: str) -> dict[str, OrderBlocks] | None:
    """Other columns of a table that is known to fit one block need no cut points either.

    Saves counting an expensive frame again; None means they have to be found.
    """
    return {c: OrderBlocks(c) for c in columns} if blocks.single else None


@dataclass
class Ordered:
    """Collects ordered columns over ``keys`` and computes them together.

    >>> Ordered(df, ["trip_id"], ["ts", "id"], blocks).lag("x", 1, "prev").frame()
    """

    df: DataFrame
    keys: list[str]
    order: list[str]
    blocks: OrderBlocks | None = None
    _numbers: list[str] = field(default_factory=list)
    _lags: list[tuple[str, int, str]] = field(default_factory=list)
    _leads: list[tuple[str, str]] = field(default_factory=list)
    _sums: list[tuple[str, str]] = field(default_factory=list)
    _totals: list[tuple[str, str, str]] = field(default_factory=list)

    def row_number(self, out: str) -> "Ordered":
        """1-based position within the key."""
        self._numbers.append(out)
        return self

    def lag(self, column: str, k: int, out: str) -> "Ordered":
        self._lags.append((column, k, out))
        return self

    def lead(self, column: str, out: str) -> "Ordered":
        self._leads.append((column, out))
        return self

    def running_sum(self, column: str, out: str) -> "Ordered":
        """Sum through the current row, nulls counting as nothing."""
        self._sums.append((column, out))
        return self

    def total(self, how: str, column: str, out: str) -> "Ordered":
        """sum, count, min or max over the whole key."""
        self._totals.append((how, column, out))
        return self

    def frame(self) -> DataFrame:
        if self.blocks and self.blocks.fits(self.keys):
            return self._plain(self.df)
        if not self.keys:
            blocks = self.blocks or order_blocks(self.df, self.order[0])
            return self._plain(self.df) if blocks.single else self._blocked(self.df, blocks)
        rows = self.blocks.rows if self.blocks else block_rows(self.df.sparkSession)
        sizes = self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_rows"))
        long = F.col("_rows") > rows
        share = sizes.agg(F.sum(F.when(long, F.col("_rows"))).alias("long"), F.sum("_rows").alias("all")).first()
        if not share["long"]:
            return self._plain(self.df)
        blocks = self.blocks or order_blocks(self.df, self.order[0], rows)
        if 2 * share["long"] >= share["all"]:
            return self._blocked(self.df, blocks)
        found = sizes.filter(long).select(*[F.col(k).alias(f"_k_{k}") for k in self.keys])
        match = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.keys])
        rest = self._plain(self.df.join(found, match, "left_anti"))
        return self._blocked(self.df.join(found, match, "left_semi"), blocks).unionByName(rest)

    def _plain(self, df: DataFrame) -> DataFrame:
        whole = Window.partitionBy(*self.keys)
        ordered = whole.orderBy(*self.order)
        running = ordered.rowsBetween(Window.unboundedPreceding, 0)
        added = {o: F.row_number().over(ordered) for o in self._numbers}
        added |= {o: F.lag(c, k).over(ordered) for c, k, o in self._lags}
        added |= {o: F.lead(c, 1).over(ordered) for c, o in self._leads}
        added |= {o: F.coalesce(F.sum(c).over(running), F.lit(0)) for c, o in self._sums}
        added |= {o: getattr(F, how)(c).over(whole) for how, c, o in self._totals}
        return df.withColumns(added)

    def _blocked(self, df: DataFrame, blocks: OrderBlocks) -> DataFrame:
        part = [*self.keys, BLOCK]
        within = Window.partitionBy(*part).orderBy(*self.order)
        running = within.rowsBetween(Window.unboundedPreceding, 0)
        depth: dict[str, int] = {}
        for c, k, _ in self._lags:
            depth[c] = max(k, depth.get(c, 0))

        tagged = blocks.tag(df)
        local = {"_rn": F.row_number().over(within)}
        local |= {f"_lag_{o}": F.lag(c, k).over(within) for c, k, o in self._lags}
        local |= {f"_lead_{o}": F.lead(c, 1).over(within) for c, o in self._leads}
        local |= {f"_sum_{o}": F.coalesce(F.sum(c).over(running), F.lit(0)) for c, o in self._sums}
        rows = tagged.withColumns(local)

        # One row per (key, block): everything other blocks of the key may need.
        tails = {
            f"_tail_{c}": F.array(F.col(c), *[F.lag(c, k).over(within) for k in range(1, d)])
            for c, d in depth.items()
        }
        partial = [F.count(F.lit(1)).alias("_n")]
        partial += [F.max_by(t, "_rn").alias(t) for t in tails]
        partial += [F.min_by(c, "_rn").alias(f"_head_{o}") for c, o in self._leads]
        partial += [F.sum(c).alias(f"_part_{o}") for c, o in self._sums]
        partial += [getattr(F, how)(c).alias(f"_part_{o}") for how, c, o in self._totals]
        summary = (
            tagged.withColumns({"_rn": local["_rn"], **tails}).groupBy(*part).agg(*partial)
        )

        key = Window.partitionBy(*self.keys)
        by_block = key.orderBy(BLOCK)
        before = by_block.rowsBetween(Window.unboundedPreceding, -1)
        carry = {"_offset": F.coalesce(F.sum("_n").over(before), F.lit(0))}
        for c, d in depth.items():
            # a non-empty block holds at least one row, so d earlier blocks suffice
            parts = [
                F.slice(F.lag(f"_tail_{c}", i).over(by_block), F.lit(1), F.lag(F.least("_n", F.lit(d)), i).over(by_block))
                for i in range(1, d + 1)
            ]
            empty = F.array().cast(T.ArrayType(df.schema[c].dataType))
            carry[f"_prev_{c}"] = F.concat(*[F.coalesce(p, empty) for p in parts])
        carry |= {f"_next_{o}": F.lead(f"_head_{o}", 1).over(by_block) for _, o in self._leads}
        carry |= {f"_base_{o}": F.coalesce(F.sum(f"_part_{o}").over(before), F.lit(0)) for _, o in self._sums}
        carry |= {
            f"_all_{o}": getattr(F, "sum" if how == "count" else how)(f"_part_{o}").over(key)
            for how, _, o in self._totals
        }
        carried = summary.select(
            *[F.col(k).alias(f"_k_{k}") for k in part], "_n", *[e.alias(n) for n, e in carry.items()]
        )
        match = None
        for k in part:
            same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
            match = same if match is None else match & same
        joined = rows.join(carried, match)

        rn = F.col("_rn")
        final = {o: rn + F.col("_offset") for o in self._numbers}
        final |= {
            o: F.when(rn > k, F.col(f"_lag_{o}")).otherwise(F.get(F.col(f"_prev_{c}"), F.lit(k) - rn))
            for c, k, o in self._lags
        }
        final |= {
            o: F.when(rn < F.col("_n"), F.col(f"_lead_{o}")).otherwise(F.col(f"_next_{o}")) for _, o in self._leads
        }
        final |= {o: F.col(f"_sum_{o}") + F.col(f"_base_{o}") for _, o in self._sums}
        final |= {o: F.col(f"_all_{o}") for _, _, o in self._totals}
        return joined.select(*df.columns, *[e.alias(n) for n, e in final.items()])


def with_index(df: DataFrame, order: list[str], out: str = "idx", total: str | None = None,
               blocks: OrderBlocks | None = None) -> DataFrame:
    """0-based position in the total order, without sorting the table in one task."""
    seq = Ordered(df, [], order, blocks).row_number("_pos")
    if total:
        seq = seq.total("count", order[0], total)
    return seq.frame().withColumn(out, (F.col("_pos") - 1).cast("long")).drop("_pos")
