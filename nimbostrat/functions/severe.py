"""Pointwise severe-weather composites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nimbostrat.functions.missing import clamp, floor_at
from nimbostrat.functions.units import MPS_TO_KT


def _positive(value: Column) -> Column:
    return floor_at(value, 0.0)


def supercell_composite(mucape: Column, srh: Column, shear_kt: Column) -> Column:
    """SCP: (MUCAPE/1000)(SRH/50) and a shear term, 0 below 10 m/s and at most 1."""
    shear = _positive(shear_kt) / MPS_TO_KT
    term = F.when(shear < 10, 0.0).otherwise(F.when(shear.isNotNull(), F.least(F.lit(1.0), shear / 20.0)))
    return _positive(mucape) / 1000.0 * (_positive(srh) / 50.0) * term


def tornado_parameter(sbcape: Column, srh: Column, lcl_m: Column, shear_kt: Column) -> Column:
    """STP: CAPE, LCL, helicity and shear terms; no shear below 12.5 m/s counts."""
    shear = _positive(shear_kt) / MPS_TO_KT
    term = F.when(shear < 12.5, 0.0).otherwise(F.when(shear.isNotNull(), F.least(F.lit(1.5), shear / 20.0)))
    return _positive(sbcape) / 1500.0 * (_positive(srh) / 150.0) * clamp((2000.0 - lcl_m) / 1000.0, 0.0, 1.0) * term


def effective_tornado_parameter(mlcape: Column, mlcin: Column, lcl_m: Column, esrh: Column, ebwd_kt: Column, base_m: Column) -> Column:
    """Effective-layer STP; 0 where the layer's base is above the ground."""
    inhibition = F.when(mlcin > -50, 1.0).otherwise(clamp((mlcin + 200.0) / 150.0, 0.0, 1.0))
    value = tornado_parameter(mlcape, esrh, lcl_m, ebwd_kt) * inhibition
    return F.when(value.isNotNull() & (base_m > 0), 0.0).otherwise(value)


def effective_candidate(mlcape: Column, mlcin: Column, sbcape: Column, sbcin: Column) -> Column:
    """Whether either parcel has CAPE >= 100 and CIN >= -250."""
    one = lambda cape, cin: F.coalesce((cape >= 100) & (cin >= -250), F.lit(False))
    return one(mlcape, mlcin) | one(sbcape, sbcin)


def lapse_rate(lower_t: Column, upper_t: Column, lower_z: Column, upper_z: Column) -> Column:
    """C/km over a layer of more than 50 m."""
    depth = (upper_z - lower_z) / 1000.0
    return F.when(depth > 0.05, F.try_divide(lower_t - upper_t, depth))


def hail_parameter(mucape: Column, mixing_ratio: Column, lapse: Column, t500_c: Column, shear_kt: Column, freezing_m: Column) -> Column:
    """SHIP with its limits, and reductions for low CAPE, lapse rate and freezing level."""
    shear, w = clamp(_positive(shear_kt) / MPS_TO_KT, 7.0, 27.0), clamp(mixing_ratio * 1000.0, 11.0, 13.6)
    cold = F.when(t500_c.isNotNull(), F.least(t500_c, F.lit(-5.5)))
    base = -1.0 * (_positive(mucape) * w * lapse * cold * shear) / 42_000_000.0
    for value, limit in ((mucape, 1300.0), (lapse, 5.8), (freezing_m, 2400.0)):
        base = F.when(value < limit, base * (value / limit)).otherwise(F.when(value.isNotNull(), base))
    return _positive(base)


def hazard_signal(cape: Column, stp: Column, scp: Column, shear_kt: Column, srh: Column, hail_in: Column) -> Column:
    """The first class whose thresholds are all reached; a missing index reaches none."""
    at = lambda c, t: F.coalesce(c >= t, F.lit(False))
    return (
        F.when(at(stp, 2) & at(cape, 500) & at(shear_kt, 30) & at(srh, 100), "TOR")
        .when(at(stp, 1) & at(cape, 500) & at(shear_kt, 25), "TOR?")
        .when(at(scp, 4) & at(cape, 1000) & at(shear_kt, 35), "SUP")
        .when(at(cape, 1000) & at(shear_kt, 30) | at(hail_in, 1), "SVR")
        .when(at(cape, 250) & at(shear_kt, 25), "MRGL")
        .otherwise("NONE")
    )
