"""Distances and schedule clock times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km; NULL when a coordinate is missing."""
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.greatest(chord, F.lit(0.0)), F.lit(1.0))))


def clock_seconds(text: Column) -> Column:
    """Seconds of "HH:MM[:SS]"; hours past 24 belong to the next day."""
    parts = F.split(F.trim(text), ":")
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)).cast("long"), F.lit(0))
    return part(0) * 3600 + part(1) * 60 + part(2)
