"""Vertical profiles: interpolation, integration and wind statistics.

A profile is the rows of one ``cell`` with p (hPa), z (m), t (K), rh (%), u and
v (m/s).  Neighbouring levels are paired by a window within the cell; whatever
follows is a filter and an aggregation over these layers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from nimbostrat.functions import thermo, winter
from nimbostrat.functions.units import MPS_TO_KT

def upwards() -> WindowSpec:
    """The levels of a cell from the lowest one up."""
    return Window.partitionBy("cell").orderBy("z", F.desc("p"))


def layers(profiles: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Each level with the next higher one, whose columns end in ``_up``."""
    return profiles.withColumns({f"{c}_up": F.lead(c).over(upwards()) for c in columns})


def at_height(profiles: DataFrame, height: float, columns: tuple[str, ...]) -> DataFrame:
    """Values at a height above the lowest level, linear in z; cells that don't reach it are left out."""
    base = F.first("z").over(upwards())
    rows = layers(profiles.withColumn("agl", F.col("z") - base), ("agl", *columns))
    inside = rows.where((F.col("agl") <= height) & ((F.col("agl_up") > height) | (F.col("agl") == height)))
    share = F.coalesce(F.try_divide(height - F.col("agl"), F.col("agl_up") - F.col("agl")), F.lit(0.0))
    return inside.select("cell", *[F.when(F.col("agl") == height, F.col(c)).otherwise(F.col(c) + share * (F.col(f"{c}_up") - F.col(c))).alias(c) for c in columns])


def at_pressure(profiles: DataFrame, pressure: float, columns: tuple[str, ...]) -> DataFrame:
    """Values at a pressure, linear in its logarithm; cells that don't span it are left out."""
    rows = layers(profiles, ("p", *columns)).where((F.col("p") >= pressure) & ((F.col("p_up") < pressure) | (F.col("p") == pressure)))
    share = F.coalesce(F.try_divide(F.ln("p") - F.ln(F.lit(pressure)), F.ln("p") - F.ln("p_up")), F.lit(0.0))
    return rows.select("cell", *[F.when(F.col("p") == pressure, F.col(c)).otherwise(F.col(c) + share * (F.col(f"{c}_up") - F.col(c))).alias(c) for c in columns])


def freezing_level(profiles: DataFrame) -> DataFrame:
    """Height of the lowest crossing from above to below 0 C; the lowest level if that is frozen."""
    zero = thermo.ZERO_C
    rows = layers(profiles, ("t", "z")).withColumn("first", F.row_number().over(upwards()) == 1)
    crossing = F.when((F.col("t") > zero) & (F.col("t_up") <= zero), F.col("z") + (F.col("t") - zero) / (F.col("t") - F.col("t_up")) * (F.col("z_up") - F.col("z")))
    return rows.groupBy("cell").agg(F.min(F.when(F.col("first") & (F.col("t") <= zero), F.col("z")).otherwise(crossing)).alias("freezing_m"))


def precipitable_water(profiles: DataFrame) -> DataFrame:
    """Millimetres of water in the layers, by trapezoids of specific humidity over pressure."""
    moist = profiles.withColumn("q", thermo.specific_humidity(thermo.dewpoint_from_rh(F.col("t"), F.col("rh")), F.col("p")))
    rows = layers(moist, ("q", "p"))
    water = (F.col("q") + F.col("q_up")) / 2 * (F.col("p") - F.col("p_up")) * (100.0 / thermo.GRAVITY)
    return rows.groupBy("cell").agg(F.sum(water).alias("pwat_mm"))


def bulk_shear(profiles: DataFrame, top: float) -> DataFrame:
    """Knots of wind difference between the lowest level and a height above it."""
    low = profiles.groupBy("cell").agg(F.min_by(F.struct("u", "v"), "z").alias("low"))
    high = at_height(profiles, top, ("u", "v"))
    du, dv = F.col("u") - F.col("low.u"), F.col("v") - F.col("low.v")
    return high.join(low, "cell").select("cell", (F.sqrt(du * du + dv * dv) * MPS_TO_KT).alias("shear_kt"))


def warmest_level(profiles: DataFrame, ground: DataFrame, least_pressure: float = 500.0) -> DataFrame:
    """Highest temperature in C at or below a pressure level, and its Kuchera ratio.

    ground: cell, surface_z, surface_t (either may be missing). Levels at or below
    the ground don't count, its own temperature does.
    """
    above = profiles.where(F.col("p") >= least_pressure).join(ground, "cell", "right")
    level = F.when(F.coalesce(F.col("z") > F.col("surface_z"), F.col("z").isNotNull()), F.col("t"))
    warm = above.groupBy("cell").agg((F.greatest(F.max(level), F.max("surface_t")) - thermo.ZERO_C).alias("warmest_c"))
    return warm.withColumn("ratio", winter.kuchera_ratio(F.col("warmest_c")))


def cobb_profile(levels: DataFrame, surface: Column) -> DataFrame:
    """Snow ratio of a profile: level ratios weighted by ascent; valid within (0, 50].

    levels: p, z, t, rh and omega (Pa/s); levels at or below the surface don't count.
    """
    weight = winter.cobb_weight(F.col("p") * 100.0, F.col("t"), F.col("omega"), F.col("rh"))
    ratio = winter.cobb_ratio(F.col("t") - thermo.ZERO_C)
    use = weight.isNotNull() & ratio.isNotNull() & (F.col("z") > surface)
    mean = F.try_divide(F.sum(F.when(use, ratio * weight)), F.sum(F.when(use, weight)))
    return levels.groupBy("cell").agg(mean.alias("ratio")).withColumn("ratio", F.when((F.col("ratio") > 0) & (F.col("ratio") <= 50), F.col("ratio")))


def lapse_rate_between(profiles: DataFrame, lower: float, upper: float) -> DataFrame:
    """C/km between two pressures."""
    low = at_pressure(profiles, lower, ("t", "z")).select("cell", F.col("t").alias("t0"), F.col("z").alias("z0"))
    high = at_pressure(profiles, upper, ("t", "z"))
    depth = (F.col("z") - F.col("z0")) / 1000.0
    return high.join(low, "cell").select("cell", F.when(depth > 0.05, (F.col("t0") - F.col("t")) / depth).alias("lapse"))
