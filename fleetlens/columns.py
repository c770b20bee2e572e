"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def resolve(df: DataFrame, candidates: Iterable[str]) -> str | None:
    """The first of several accepted column names that the table has."""
    return next((c for c in candidates if c in df.columns), None)


def with_default(df: DataFrame, name: str, value) -> DataFrame:
    """Fill a missing column, or the nulls of a present one, with a constant."""
    default = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(name, F.coalesce(F.col(name), default) if name in df.columns else default)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing at every source, so turn it into NULL once."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c)
            for c in df.columns
        ]
    )


def round_to(value: Column, digits: int) -> Column:
    """Half-away rounding of the binary value, in codegen (no BigDecimal per row)."""
    scale = float(10**digits)
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5).cast("double") / scale


def clip(value: Column, low: float, high: float) -> Column:
    """Bound a value; NULL stays NULL."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def flag(condition: Column) -> Column:
    """1/0 from a condition, NULL counting as false."""
    return F.when(condition, 1).otherwise(0)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp of either kind."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide numeric columns to (ids, feature, value) rows."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(ids, columns, name, value)
