"""Calendar and clock features."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: morning and evening peak in minutes of the day, both ends included
MORNING_PEAK = (420, 540)
EVENING_PEAK = (990, 1110)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def is_peak(ts: Column) -> Column:
    now = minute_of_day(ts)
    return now.between(*MORNING_PEAK) | now.between(*EVENING_PEAK)


def cycle(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a position on a cycle."""
    angle = F.lit(2.0 * pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)
