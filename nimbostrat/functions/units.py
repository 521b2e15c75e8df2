"""Unit transforms of forecast fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nimbostrat.functions.missing import clamp, floor_at

# Conversion factors.
MPS_TO_KT = 1.943844
MPS_TO_MPH = 2.2369362920544
MM_TO_IN = 1 / 25.4
M_TO_IN = 39.3701
M_TO_FT = 3.28084
M_TO_MI = 1 / 1609.344

# Name -> (scale, offset) of the named transforms.
AFFINE = {
    "kelvinToFahrenheit": (1.8, -459.67),
    "kelvinToCelsius": (1.0, -273.15),
    "pascalToHpa": (0.01, 0.0),
    "kgKgToGkg": (1000.0, 0.0),
    "metersToMiles": (M_TO_MI, 0.0),
    "metersToFeet": (M_TO_FT, 0.0),
    "metersToDam": (0.1, 0.0),
    "metersToInches": (M_TO_IN, 0.0),
    "kgM2ToWaterInches": (MM_TO_IN, 0.0),
    "absoluteVorticity1e5": (1e5, 0.0),
    "paSToDPaS": (10.0, 0.0),
    "metersPerSecondToKnots": (MPS_TO_KT, 0.0),
    "metersPerSecondToMph": (MPS_TO_MPH, 0.0),
}


def transform(value: Column, name: str, low: float | None = None) -> Column:
    """One named affine transform, with an optional lower limit; other names change nothing."""
    scale, offset = AFFINE.get(name, (1.0, 0.0))
    out = value * F.lit(scale) + F.lit(offset)
    return out if low is None else floor_at(out, low)


def precip_rate(value: Column, hours: Column) -> Column:
    """Millimetres over some hours as inches an hour, at least 0."""
    return floor_at(F.try_divide(value * F.lit(MM_TO_IN), hours), 0.0)


def wind_speed(u: Column, v: Column, factor: float = MPS_TO_KT) -> Column:
    return F.sqrt(u * u + v * v) * F.lit(factor)


def wind_direction(u: Column, v: Column) -> Column:
    """Degrees from which the wind blows, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(-u, -v)) + 360.0, F.lit(360.0))


def wind_components(speed: Column, direction: Column) -> tuple[Column, Column]:
    """(u, v) of a speed and the direction it comes from."""
    angle = F.radians(direction)
    return -speed * F.sin(angle), -speed * F.cos(angle)


def above_ground(height: Column, surface: Column) -> Column:
    return floor_at(height - surface, 0.0)


def thickness(upper: Column, lower: Column) -> Column:
    """Decametres between two heights in metres."""
    return (upper - lower) / 10.0


# Quantisation steps by unit.
STEPS = {
    "F": 0.05, "C": 0.05, "hPa": 0.05, "in": 0.01, "in/hr": 0.001, "%": 0.1, "mph": 0.1, "kt": 0.1,
    "dBZ": 0.1, "mi": 0.1, "mm": 0.1, "ft": 5.0, "m": 1.0, "J/kg": 1.0, "m2/s2": 1.0,
}
MISSING_CODE, MOST_CODE = -32768, 32767


def step_of(unit: Column) -> Column:
    """The quantisation step of a unit; 0.1 for others."""
    table = F.create_map(*[F.lit(x) for pair in STEPS.items() for x in pair])
    return F.coalesce(table[unit], F.lit(0.1))


def quantise(value: Column, step: Column) -> Column:
    """16-bit codes, rounded half up and clamped; a missing value has its own code."""
    code = clamp(F.floor(value / step + 0.5), -MOST_CODE, MOST_CODE)
    return F.coalesce(code, F.lit(MISSING_CODE)).cast("smallint")


def dequantise(code: Column, step: Column, offset: Column | None = None) -> Column:
    value = F.when(code != MISSING_CODE, code * step)
    return value if offset is None else value + offset
