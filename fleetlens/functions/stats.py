"""Statistics as Column expressions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def kolmogorov_p(statistic: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample p-value of the KS statistic.

    2 * sum (-1)^(k-1) exp(-2 k^2 x^2); 1 where the series has not started to decay.
    """
    x = statistic * F.sqrt(n1 * n2 / (n1 + n2))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x),
    )
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(2.0 * series, F.lit(0.0)), F.lit(1.0)))


def path_share(statistic: float, n1: int, n2: int) -> float:
    """Probability that two samples of one distribution without ties have at least this KS statistic.

    A merged order is a lattice path from (0, 0) to (n1, n2), all equally likely; the probability is the share of paths that leave the band
    |i/n1 - j/n2| < statistic. Mass moves from one diagonal to the next and is taken out where it leaves, so small
    probabilities keep their digits; only places inside the band are kept.
    """
    return _share_beyond(round(statistic * n1 * n2), n1, n2)  # the statistic is a multiple of 1 / (n1 * n2)


@lru_cache(maxsize=100_000)
def _share_beyond(bound: int, n1: int, n2: int) -> float:
    """Windows of one size have as many different statistics as records, so a worker counts each once."""
    if bound <= 0:
        return 1.0
    mass, low, left = np.ones(1), 0, 0.0
    for k in range(n1 + n2):
        i = low + np.arange(len(mass))  # places (i, k - i)
        right = mass * (n1 - i) / (n1 + n2 - k)
        moved = np.append(mass - right, 0.0)
        moved[1:] += right
        i = low + np.arange(len(moved))
        out = np.abs(i * n2 - (k + 1 - i) * n1) >= bound
        left += float(moved[out].sum())
        kept = np.flatnonzero(~out & (moved > 0))
        if not len(kept):
            return min(left, 1.0)
        low, mass = low + int(kept[0]), np.where(out, 0.0, moved)[kept[0]:kept[-1] + 1]
    return min(left, 1.0)


def exact_kolmogorov_p(statistic: Column, n1: Column, n2: Column) -> Column:
    """Exact two-sample p-value of the KS statistic, in Arrow batches; its work grows with (n1 + n2) times the width of the band."""

    @F.pandas_udf("double")
    def p_values(d: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([path_share(x, int(m), int(n)) if m > 0 and n > 0 and x == x else None for x, m, n in zip(d, a, b, strict=True)], dtype="float64")

    return p_values(statistic.cast("double"), n1.cast("long"), n2.cast("long"))


def hash_route(key: Column, percent: int) -> Column:
    """Whether md5(key) mod 100 falls below a percentage; 0 is nobody, 100 everybody.

    The 128-bit digest is reduced in two 64-bit halves: 2^64 mod 100 = 16.
    """
    if percent <= 0:
        return F.lit(False)
    if percent >= 100:
        return F.lit(True)
    digest = F.md5(key.cast("string").cast("binary"))

    def half(start: int) -> Column:
        return F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(20,0)") % 100

    return ((half(1) * 16 + half(17)) % 100) < percent


def row_digest(columns: list[Column]) -> Column:
    """SHA-256 of one row with the column boundaries and nulls kept apart."""
    parts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)
