"""Named queries with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import use_utc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def with_ctes(names: tuple[str, ...], sql: str) -> str:
    """Prefix a statement with the named tables and what they need, in order."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name not in done:
            for n in CTES[name][0]:
                visit(n)
            done.append(name)

    for n in names:
        visit(n)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done)
    return f"WITH {head}\n{sql}" if head else sql


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query, with its SQL when the result can be stated in SQL."""

    def add(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(use_utc(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_ctes(needs, sql)
        return run

    return add


NUDGE = 1.7e-10


def r6(value: Column | str) -> Column:
    """Six digits; the nudge moves decimal ties off the rounding boundary in both engines."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(c.cast("double") + F.lit(NUDGE), 6)


def s6(expression: str) -> str:
    return f"round(CAST({expression} AS DOUBLE) + {NUDGE}, 6)"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def half_up(expression: str, digits: int = 2) -> str:
    scale = 10**digits
    return f"(sign({expression}) * floor(abs({expression}) * {scale}.0::DOUBLE + 0.5::DOUBLE) / {scale}.0::DOUBLE)"


def clean_time(column: str) -> Column:
    """Timestamps leave a query without a zone, as the SQL side has them."""
    return F.col(column).cast("timestamp_ntz")
