"""Thermodynamics of moist air as column functions.

Temperatures are in kelvins unless a name ends in ``_c``; pressures in hPa.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nimbostrat.functions.missing import clamp

# Physical constants.
KAPPA, GRAVITY, EPSILON, R_DRY, CP_DRY, LATENT = 0.2854, 9.80665, 0.622, 287.05, 1004.0, 2.5e6
DRY_LAPSE = 0.0098
ZERO_C = 273.15


def vapour_pressure(dewpoint: Column) -> Column:
    c = dewpoint - ZERO_C
    return 6.112 * F.exp(17.67 * c / (c + 243.5))


def dewpoint_from_vapour_pressure(e: Column) -> Column:
    x = F.when(e > 0, F.ln(e / 6.112))
    return F.try_divide(243.5 * x, 17.67 - x) + ZERO_C


def dewpoint_from_rh(temperature: Column, rh: Column) -> Column:
    """Magnus dewpoint; humidity is clamped to 1..100 % and missing at or below 0."""
    c = temperature - ZERO_C
    gamma = F.ln(clamp(F.when(rh > 0, rh), 1.0, 100.0) / 100.0) + 17.625 * c / (c + 243.04)
    return 243.04 * gamma / (17.625 - gamma) + ZERO_C


def relative_humidity(temperature: Column, dewpoint: Column) -> Column:
    return clamp(100.0 * vapour_pressure(dewpoint) / vapour_pressure(temperature), 1.0, 100.0)


def mixing_ratio(e: Column, pressure: Column) -> Column:
    """kg/kg; missing unless 0 < e < p."""
    return F.when((e > 0) & (e < pressure), F.try_divide(EPSILON * e, pressure - e))


def mixing_ratio_from_dewpoint(dewpoint: Column, pressure: Column) -> Column:
    return mixing_ratio(vapour_pressure(dewpoint), pressure)


def specific_humidity(dewpoint: Column, pressure: Column) -> Column:
    w = mixing_ratio_from_dewpoint(dewpoint, pressure)
    return w / (1.0 + w)


def virtual_temperature(temperature: Column, w: Column) -> Column:
    return temperature * (1.0 + w / EPSILON) / (1.0 + w)


def potential_temperature(temperature: Column, pressure: Column, reference: float = 1000.0) -> Column:
    return temperature * F.pow(F.try_divide(F.lit(reference), pressure), F.lit(KAPPA))


def lcl_temperature(temperature: Column, dewpoint: Column) -> Column:
    """Bolton's temperature at the lifting condensation level."""
    return 56.0 + 1.0 / (1.0 / (dewpoint - 56.0) + F.ln(temperature / dewpoint) / 800.0)


def lcl_height(temperature: Column, dewpoint: Column) -> Column:
    """Metres above the parcel by dry ascent, at least 0."""
    depth = (temperature - lcl_temperature(temperature, dewpoint)) / DRY_LAPSE
    return F.when(depth.isNotNull(), F.greatest(depth, F.lit(0.0)))


def theta_e(temperature: Column, dewpoint: Column, pressure: Column) -> Column:
    """Bolton's equivalent potential temperature; needs p > 100 and 0 < e < p."""
    e = vapour_pressure(dewpoint)
    w = F.when(pressure > 100, mixing_ratio(e, pressure))
    t_lcl = lcl_temperature(temperature, dewpoint)
    base = temperature * F.pow(F.try_divide(F.lit(1000.0), pressure - e), KAPPA * (1.0 - 0.28 * w))
    return base * F.exp((3376.0 / t_lcl - 2.54) * w * (1.0 + 0.81 * w))


def moist_lapse_rate(temperature: Column, pressure: Column) -> Column:
    """K/m along a saturated ascent."""
    w = mixing_ratio(vapour_pressure(temperature), pressure)
    top = 1.0 + LATENT * w / (R_DRY * temperature)
    bottom = CP_DRY + LATENT * LATENT * w * EPSILON / (R_DRY * temperature * temperature)
    return GRAVITY * top / bottom


def wet_bulb_c(temperature: Column, dewpoint: Column) -> Column:
    """Stull's surface wet bulb in degrees Celsius."""
    t, rh = temperature - ZERO_C, relative_humidity(temperature, dewpoint)
    return (
        t * F.atan(0.151977 * F.sqrt(rh + 8.313659)) + F.atan(t + rh) - F.atan(rh - 1.676331)
        + 0.00391838 * F.pow(rh, F.lit(1.5)) * F.atan(0.023101 * rh) - 4.686035
    )


def station_pressure(surface_pa: Column, sea_level_pa: Column, height: Column, temperature: Column) -> Column:
    """hPa: the surface pressure if above 1000 Pa, else the sea-level pressure.

    The latter is reduced to heights above 1 m where height and temperature are known.
    """
    below = temperature + 0.0065 * height
    ratio = 1.0 - F.try_divide(0.0065 * height, F.when(below > 0, below))
    reduced = F.when(height > 1, sea_level_pa / 100.0 * F.pow(ratio, F.lit(5.257)))
    return F.coalesce(F.when(surface_pa > 1000, surface_pa / 100.0), reduced, sea_level_pa / 100.0)
