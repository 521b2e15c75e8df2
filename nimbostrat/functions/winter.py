"""Winter-precipitation column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nimbostrat.functions.missing import clamp, floor_at

MOST_RATIO = 60.0
TRACE_IN = 0.1 / 60

# Lower bounds of the temperature bins in C, and the coefficients
# of each bin's cubic in the distance from its bound.
COBB_FROM = [-24, -21, -19, -16, -12, -10, -8, -7, -5, -3, 0]
COBB_C1 = [8, 12, 21, 30, 19, 9, 8, 9, 13, 6, 2]
COBB_C2 = [-0.0017, 3.5034, 4.9065, -0.465, -4.7608, -2.0799, 0.3122, 2.0127, -0.7004, -3.711, 0]
COBB_C3 = [0, 1.1684, -0.4668, -1.0679, -0.1594, 1.2318, 0.363, 1.3375, -2.6941, 1.1888, 0]
COBB_C4 = [0.1298, -0.2725, -0.0573, 0.0865, 0.1855, -0.1931, 0.3249, -0.6719, 0.6472, -0.1321, 0]


def kuchera_ratio(max_temperature_c: Column) -> Column:
    """Snow-to-liquid ratio from the warmest low level, within 3..50."""
    above = -2.0 - max_temperature_c
    return clamp(F.when(max_temperature_c > -2, 12.0 + 2.0 * above).otherwise(12.0 + above), 3.0, 50.0)


def ice_liquid_ratio(rate_in: Column, wet_bulb_c: Column, wind_kt: Column) -> Column:
    """FRAM: share of liquid that freezes on a flat surface; missing without precipitation."""
    p, t = F.greatest(F.lit(0.02), rate_in), F.greatest(F.lit(-7.0), wet_bulb_c)
    a = 0.1395 * F.pow(p, F.lit(-0.541))
    b = -0.0071 * t * t * t - 0.1039 * t * t - 0.3904 * t + 0.5545
    c = 0.0014 * wind_kt * wind_kt + 0.0027 * wind_kt + 0.7574
    value = (
        F.when(t > -0.35, 0.7 * a + 0.29 * b + 0.01 * c)
        .when(wind_kt > 12, 0.73 * a + 0.01 * b + 0.26 * c)
        .otherwise(0.79 * a + 0.2 * b + 0.01 * c)
    )
    complete = (rate_in > 0) & wet_bulb_c.isNotNull() & wind_kt.isNotNull()
    return F.when(complete, floor_at(value, 0.0))


RADIAL_SHARE = 0.394


def cobb_ratio_at(t: Column) -> Column:
    """Layer ratio at one temperature in C: missing from 0 to 3, 0 above."""
    out = F.when(t < COBB_FROM[0], float(COBB_C1[0]))
    for low, high, c1, c2, c3, c4 in zip(COBB_FROM, COBB_FROM[1:], COBB_C1, COBB_C2, COBB_C3, COBB_C4, strict=False):
        d = t - float(low)
        out = out.when(t < high, float(c1) + d * (float(c2) + d * (float(c3) + d * float(c4))))
    return out.when(t > 3, 0.0)


def cobb_ratio(t: Column) -> Column:
    """Mean of the present ratios at t, t+1 and t+2."""
    parts = [cobb_ratio_at(t + k) for k in (0.0, 1.0, 2.0)]
    total = F.coalesce(parts[0], F.lit(0.0)) + F.coalesce(parts[1], F.lit(0.0)) + F.coalesce(parts[2], F.lit(0.0))
    n = sum(p.isNotNull().cast("int") for p in parts)
    return F.when(n > 0, F.try_divide(total, n))


def cobb_weight(pressure_pa: Column, temperature: Column, omega: Column, rh: Column) -> Column:
    """A level's weight: the root of its ascent in cm/s, less below 80 % humidity; missing for descent."""
    w = -100.0 * (omega / 9.8 / (pressure_pa / (287.058 * temperature)))
    root = F.sqrt(F.when(w >= 0, w))
    weight = F.when(rh >= 80, root).otherwise(root * (rh * rh / 6400.0))
    return F.when(weight > 0, weight)


def linear_ratio(intercept: float, coefficients: list[float], features: list[Column]) -> Column:
    """A linear model's ratio; missing if any feature is."""
    return sum((F.lit(b) * x for b, x in zip(coefficients, features, strict=True)), F.lit(intercept))


def snowfall_increment(liquid: Column, ratio: Column, from_trace: bool = False) -> Column:
    """Snow of an interval: missing liquid or ratio is missing, no liquid adds nothing."""
    least = TRACE_IN if from_trace else 0.0
    r = clamp(ratio, 1.0, MOST_RATIO) if from_trace else ratio
    return F.when(liquid <= least, 0.0).otherwise(liquid * r)


def precip_type(rain: Column, snow: Column, freezing: Column, sleet: Column) -> Column:
    """The first of freezing rain, sleet, snow and rain whose mask is at least 0.5."""
    return (
        F.when(freezing >= 0.5, "freezing").when(sleet >= 0.5, "sleet").when(snow >= 0.5, "snow").when(rain >= 0.5, "rain")
    )
