"""Predicates on places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The metro's box, south, north, west, east.
METRO = (41.35, 42.45, -88.45, -87.30)


def in_bounds(lat: Column, lng: Column, box: tuple[float, float, float, float] = METRO) -> Column:
    """Within a box, edges included. Null and NaN are never inside."""
    south, north, west, east = box
    inside = lat.between(south, north) & lng.between(west, east) & ~F.isnan(lat.cast("double")) & ~F.isnan(lng.cast("double"))
    return F.coalesce(inside, F.lit(False))


def bounds_first(lat: Column, lng: Column, key: Column, always: int, box: tuple[float, float, float, float] = METRO) -> tuple[Column, Column]:
    """A filter that also admits one id, and the sort key that puts it first."""
    return in_bounds(lat, lng, box) | (key == always), F.when(key == always, 0).otherwise(1)
