"""Category labels of report dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: report labels
DIRECTIONS = {1: "Outbound (Kandy -> Digana)"}
OTHER_DIRECTION = "Inbound (Digana -> Kandy)"
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
WEATHER = {
    "Clear Sky": [0],
    "Mainly Clear / Overcast": [1, 2, 3],
    "Fog": [45, 48],
    "Rain / Shower": [51, 53, 55, 61, 63, 65, 80, 81, 82],
    "Thunderstorm": [95, 96, 99],
}
PRECIPITATION_TIERS = ([-0.01, 0.0, 1.0, 5.0, 100.0],
                       ["No Rain (0 mm)", "Light Rain (0-1 mm)", "Moderate Rain (1-5 mm)", "Heavy Rain (>5 mm)"])
CONGESTION_TIERS = ([-0.1, 0.9, 1.3, 100.0],
                    ["Free Flow (Ratio < 0.9)", "Normal (Ratio 0.9-1.3)", "Congested (Ratio > 1.3)"])
TARGET_TIERS = ([0, 60, 120, 240, 480, 10000],
                ["Short (< 1 min)", "Medium (1-2 min)", "Standard (2-4 min)", "Long (4-8 min)", "Extreme (> 8 min)"])
ERROR_BUCKETS = ([0, 10, 20, 40, 60, 100],
                 ["0-10s", "10-20s", "20-40s", "40-60s", "60-100s", "100s+"])


def right_closed(value: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """Label of the (low, high] interval that holds the value, NULL outside all."""
    label = F.when(value <= edges[0], None)
    for high, name in zip(edges[1:], names):
        label = label.when(value <= high, name)
    return label


def left_closed(value: Column, starts: Sequence[float], names: Sequence[str]) -> Column:
    """Label of the [low, next) interval that holds the value; the last is open."""
    label = F.lit(None).cast("string")
    for low, name in zip(starts, names):
        label = F.when(value >= low, name).otherwise(label)
    return label


def lookup(value: Column, mapping: dict, default) -> Column:
    """Dictionary lookup with a default for unknown or missing keys."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(table, value), F.lit(default))


def weather_label(code: Column) -> Column:
    known = F.coalesce(code.cast("int"), F.lit(0))
    label = F.concat(F.lit("Weather Code "), known.cast("string"))
    for name, codes in WEATHER.items():
        label = F.when(known.isin(codes), name).otherwise(label)
    return label


def direction_label(direction: Column) -> Column:
    return lookup(direction.cast("int"), DIRECTIONS, OTHER_DIRECTION)


def weekday_label(day: Column) -> Column:
    """Monday is 0; days out of range keep their number."""
    names = F.array(*[F.lit(n) for n in WEEKDAYS])
    return F.coalesce(F.get(names, day.cast("int")), F.concat(F.lit("Day_"), day.cast("string")))


def segment_label(segment: Column) -> Column:
    return F.format_string("Segment_%d", segment.cast("int"))


def hour_label(hour: Column) -> Column:
    return F.format_string("%02d:00", hour.cast("int"))


def peak_label(flag: Column) -> Column:
    return F.when(flag == 1, "Peak Period").otherwise("Off-Peak")
