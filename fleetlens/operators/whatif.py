"""Disturbance what-ifs as column transforms over a feature table.

A scenario adjusts observed features and the simulated outcome of the rows it
applies to.  ``actual`` is the outcome column; ``disturbance_applied`` marks rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.columns import round_to
from fleetlens.functions.calendar import is_peak

ACTUAL = "actual"
APPLIED = "disturbance_applied"


@dataclass(frozen=True)
class Adjustment:
    """New value of one column from the old one; digits of None leaves it unrounded."""

    column: str
    value: Callable[[Column, float], Column]
    digits: int | None = None


def scale(column: str, factor: float, digits: int) -> Adjustment:
    return Adjustment(column, lambda c, i: c * F.lit(1.0 + factor * i), digits)


def shift(column: str, amount: float, digits: int = 2) -> Adjustment:
    return Adjustment(column, lambda c, i: c + F.lit(amount * i), digits)


def floor_at(column: str, base: float, slope: float, digits: int, ceiling: float | None = None) -> Adjustment:
    def raised(c: Column, i: float) -> Column:
        out = F.greatest(c, F.lit(base + slope * i))
        return out if ceiling is None else F.least(out, F.lit(ceiling))

    return Adjustment(column, raised, digits)


def fixed(column: str, value) -> Adjustment:
    return Adjustment(column, lambda c, i: F.lit(value(i) if callable(value) else value))


@dataclass(frozen=True)
class Scenario:
    """A named set of adjustments with where and when it applies."""

    scenario_id: str
    name: str
    intensity: float
    steps: tuple[tuple[Adjustment, ...], ...] = ()
    start: str | None = None
    end: str | None = None
    segments: tuple[int, ...] | None = None
    peak_only: bool = False

    def __post_init__(self):
        if not 0.0 <= self.intensity <= 1.0:
            raise ValueError(f"intensity must be within [0, 1], got {self.intensity}")

    @property
    def synthetic(self) -> bool:
        return bool(self.steps) and self.intensity > 0.0

    def active(self, ts: Column, segment: Column) -> Column:
        """Whether a row is affected: intensity, segment set and time range."""
        if not self.synthetic:
            return F.lit(False)
        condition = F.lit(True)
        if self.segments:
            condition &= segment.isin(list(self.segments))
        if self.start:
            condition &= ts >= F.lit(self.start).cast("timestamp")
        if self.end:
            condition &= ts <= F.lit(self.end).cast("timestamp")
        if self.peak_only and not (self.start or self.end):
            condition &= is_peak(ts)
        return condition

    def applied(self, ts: str, segment: str) -> Column:
        return F.coalesce(self.active(F.col(ts), F.col(segment)), F.lit(False))

    def adjusted(self, df: DataFrame, applied: Column) -> dict[str, Column]:
        """New value per touched column; several steps round after each, in order."""
        values: dict[str, Column] = {}
        for step in self.steps if self.synthetic else ():
            before = dict(values)
            for a in step:
                if a.column in df.columns:
                    new = a.value(before.get(a.column, F.col(a.column)), self.intensity)
                    values[a.column] = new if a.digits is None else round_to(new, a.digits)
        return {c: F.when(applied, v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()}

    def apply(self, df: DataFrame, ts: str = "timestamp_utc", segment: str = "segment") -> DataFrame:
        """Adjust the affected rows and mark them."""
        marked = df.withColumn(APPLIED, self.applied(ts, segment))
        changes = self.adjusted(df, F.col(APPLIED))
        return marked.withColumns(changes) if changes else marked

    def at(self, intensity: float) -> "Scenario":
        return replace(self, intensity=intensity)


RATIO, PREVIOUS, ROLLING = "segment_delay_ratio", "previous_segment_run_time", "rolling_prev_segment_mean"

# fixed values: effect sizes of the disturbances
RUSH_STEP = (fixed("is_peak_period", 1), fixed("congestion_proxy", 1), scale(RATIO, 0.60, 4),
             scale(PREVIOUS, 0.35, 2), scale(ROLLING, 0.35, 2), scale(ACTUAL, 0.70, 2))
RAIN_STEP = (floor_at("precipitation", 0.0, 16.0, 2), floor_at("rain", 0.0, 14.0, 2),
             floor_at("relative_humidity_2m", 88.0, 10.0, 1, ceiling=100.0),
             fixed("weather_code", lambda i: 65 if i > 0.5 else 63), scale(RATIO, 0.25, 4), scale(ACTUAL, 0.35, 2))
SURGE_STEP = (fixed("congestion_proxy", 1), scale(RATIO, 1.10, 4), scale(PREVIOUS, 0.75, 2),
              scale(ROLLING, 0.75, 2), scale(ACTUAL, 1.05, 2))
INCIDENT_STEP = (fixed("congestion_proxy", 1), scale(RATIO, 1.50, 4),
                 Adjustment(ACTUAL, lambda c, i: c * F.lit(1.0 + 1.40 * i) + F.lit(80.0 * i), 2))
DWELL_STEP = (shift("cumulative_trip_time_sec", 90.0), shift(PREVIOUS, 40.0), shift(ACTUAL, 65.0))

BASELINE = Scenario("BASELINE", "Baseline Replay", 0.0)
RUSH_HOUR = Scenario("RUSH_HOUR", "Rush Hour Congestion Surge", 0.75, (RUSH_STEP,), peak_only=True)
HEAVY_RAIN = Scenario("HEAVY_RAIN", "Heavy Monsoon Rain", 0.80, (RAIN_STEP,))
CONGESTION_SURGE = Scenario("CONGESTION_SURGE", "Corridor Congestion Surge", 0.70, (SURGE_STEP,))
ROAD_INCIDENT = Scenario("ROAD_INCIDENT", "Localized Road Incident", 0.85, (INCIDENT_STEP,), segments=(8, 9, 10))
DWELL_SURGE = Scenario("DWELL_SURGE", "Passenger Dwell-Time Surge", 0.75, (DWELL_STEP,))
COMBINED_DISRUPTION = Scenario("COMBINED_DISRUPTION", "Compound Severe Disruption", 0.85,
                               (RAIN_STEP, SURGE_STEP, DWELL_STEP))

CATALOG = {s.scenario_id: s for s in (BASELINE, RUSH_HOUR, HEAVY_RAIN, CONGESTION_SURGE, ROAD_INCIDENT,
                                      DWELL_SURGE, COMBINED_DISRUPTION)}


def register(scenario: Scenario) -> None:
    """Add a user scenario to the catalog."""
    CATALOG[scenario.scenario_id] = scenario


def scenario_rows(df: DataFrame, scenarios: Sequence[Scenario] | None = None, ts: str = "timestamp_utc",
                  segment: str = "segment") -> DataFrame:
    """Every scenario over the same rows, tagged with ``scenario_id``.

    The input is computed once: each row becomes one struct per scenario, without
    a join or a shuffle.
    """
    chosen = list(scenarios or CATALOG.values())
    touched = sorted({a.column for s in chosen for step in s.steps for a in step} & set(df.columns))
    versions = []
    for s in chosen:
        hit = s.applied(ts, segment)
        new = s.adjusted(df, hit)
        versions.append(F.struct(F.lit(s.scenario_id).alias("scenario_id"), hit.alias(APPLIED),
                                 *[new.get(c, F.col(c)).alias(c) for c in touched]))
    rest = [c for c in df.columns if c not in touched]
    return df.select(*rest, F.explode(F.array(*versions)).alias("_s")).select(*rest, "_s.*")


def shared_columns(columns: Sequence[str], scenarios: Sequence[Scenario] | None = None) -> dict[str, dict[str, list[str]]]:
    """Per column: the first scenario that leaves it alone, and the others that do, whose values are the same."""
    chosen = list(scenarios or CATALOG.values())
    found = {}
    for c in columns:
        alike = [s.scenario_id for s in chosen if not s.synthetic or all(a.column != c for step in s.steps for a in step)]
        if len(alike) > 1:
            found[c] = {alike[0]: alike[1:]}
    return found


def without_copies(df: DataFrame, shared: dict[str, dict[str, list[str]]], key: str = "scenario_id") -> DataFrame:
    """Null where a scenario's values of a column are those of another one."""
    copies = {c: [x for others in groups.values() for x in others] for c, groups in shared.items()}
    return df.withColumns({c: F.when(~F.col(key).isin(ids), F.col(c)) for c, ids in copies.items() if c in df.columns})


def describe(df: DataFrame, scenarios: Sequence[Scenario] | None = None) -> DataFrame:
    """Catalog entries with the number of rows of a table that each affects."""
    chosen = list(scenarios or CATALOG.values())
    hits = df.agg(*[F.count_if(s.active(F.col("timestamp_utc"), F.col("segment"))).alias(s.scenario_id)
                    for s in chosen]).unpivot([], [s.scenario_id for s in chosen], "scenario_id", "affected_rows")
    row = F.create_map(*[x for s in chosen for x in (F.lit(s.scenario_id), F.struct(
        F.lit(s.name).alias("name"), F.lit(s.intensity).alias("intensity"),
        F.lit(int(s.synthetic)).cast("long").alias("is_synthetic"),
        F.lit(",".join(map(str, s.segments)) if s.segments else "GLOBAL").alias("affected_segments")))])
    return hits.select("scenario_id", "affected_rows", row[F.col("scenario_id")].alias("s")).select(
        "scenario_id", "affected_rows", "s.*")
