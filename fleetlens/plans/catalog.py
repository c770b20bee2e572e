"""All registered queries."""

from __future__ import annotations

from fleetlens.plans import decision_queries, drift_queries, evaluation_queries, preparation, stream_queries  # noqa: F401
from fleetlens.plans.registry import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(sorted(QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    return dict(sorted(ORACLE.items()))
