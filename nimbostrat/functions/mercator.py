"""Raster rows and latitudes of Mercator-spaced grids."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from nimbostrat.functions.missing import clamp

MOST_LATITUDE = 85.05112878


@dataclass(frozen=True)
class Bounds:
    """The edges of a view in degrees."""

    north: float
    south: float
    west: float
    east: float


# The two views.
CONUS = Bounds(53.0, 21.0, -129.0, -63.0)
NORTH_AMERICA = Bounds(74.0, 7.0, -170.0, -45.0)


def mercator_y(latitude: Column) -> Column:
    return F.ln(F.tan(math.pi / 4 + F.radians(clamp(latitude, -MOST_LATITUDE, MOST_LATITUDE)) / 2.0))


def latitude_of(y: Column) -> Column:
    return F.degrees(2.0 * F.atan(F.exp(y)) - math.pi / 2)


def _y(latitude: float) -> float:
    return math.log(math.tan(math.pi / 4 + math.radians(latitude) / 2))


def row_latitude(row: Column, rows: int | Column, bounds: Bounds) -> Column:
    """Latitude of a raster row; row 0 is north."""
    north, south = _y(bounds.north), _y(bounds.south)
    last = F.greatest(F.lit(rows) - 1 if isinstance(rows, int) else rows - 1, F.lit(1))
    return latitude_of(north + (south - north) * row / last)


def latitude_row(latitude: Column, rows: int | Column, bounds: Bounds) -> Column:
    """Fractional raster row of a latitude, within the raster."""
    north, south = _y(bounds.north), _y(bounds.south)
    last = F.lit(rows) - 1 if isinstance(rows, int) else rows - 1
    return clamp((mercator_y(latitude) - north) / (south - north) * last, 0.0, last)


def column_longitude(col: Column, cols: int | Column, bounds: Bounds) -> Column:
    last = F.greatest(F.lit(cols) - 1 if isinstance(cols, int) else cols - 1, F.lit(1))
    return bounds.west + (bounds.east - bounds.west) * col / last


def coriolis(latitude: Column) -> Column:
    return 2 * 7.2921e-5 * F.sin(F.radians(latitude))
