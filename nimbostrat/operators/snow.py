"""Phase-masked liquid and snowfall over forecast intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nimbostrat.functions import thermo, winter
from nimbostrat.functions.missing import clamp, floor_at, poison_sum
from nimbostrat.functions.units import MPS_TO_KT

PHASES = ("snow", "rain", "freezing", "sleet")


def mask_share(phase: str) -> Column:
    """clamp01(phase) over the sum of the clamped masks; missing unless all four are known."""
    parts = [clamp(F.col(p), 0.0, 1.0) for p in PHASES]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    return F.when(total > 0, clamp(F.col(phase), 0.0, 1.0) / total).otherwise(F.when(total.isNotNull(), 0.0))


def sample_weights(samples: DataFrame, start: int, keys: tuple[str, ...]) -> DataFrame:
    """Samples of an interval with the hours since the sample before, the first since ``start``."""
    order = Window.partitionBy(*keys).orderBy("hour")
    return samples.withColumn("weight", F.col("hour") - F.lag("hour", 1, start).over(order))


def interval_share(samples: DataFrame, phase: str, keys: tuple[str, ...]) -> DataFrame:
    """Weighted mean share over the samples whose masks are complete."""
    rows = samples.withColumn("share", mask_share(phase))
    weight = F.when(F.col("share").isNotNull(), F.col("weight"))
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col("share") * F.col("weight")), F.sum(weight)).alias("share"))


def phase_masked(liquid: Column, share: Column) -> Column:
    """Liquid of one phase: none without precipitation, missing without masks."""
    return F.when(liquid <= 0, 0.0).otherwise(liquid * share)


def snowfall(chunks: DataFrame, keys: tuple[str, ...], ratio: Column, from_trace: bool = False) -> DataFrame:
    """Sum over the chunks of a cell of liquid times ratio; a missing chunk poisons it."""
    step = winter.snowfall_increment(F.col("liquid"), ratio, from_trace)
    return chunks.groupBy(*keys).agg(poison_sum(step).alias("snow"))


def ice_accretion(chunks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Flat and radial ice from chunks of liquid_in, hours, wet_bulb_c and wind_kt."""
    rate = F.try_divide(F.col("liquid_in"), F.col("hours"))
    flat = F.when(F.col("liquid_in") <= 0, 0.0).otherwise(F.col("liquid_in") * winter.ice_liquid_ratio(rate, F.col("wet_bulb_c"), F.col("wind_kt")))
    out = chunks.groupBy(*keys).agg(floor_at(poison_sum(flat), 0.0).alias("flat_ice"))
    return out.withColumn("radial_ice", F.col("flat_ice") * winter.RADIAL_SHARE)


def active_cells(fields: DataFrame, threshold: float, keys: tuple[str, ...], dense: float = 0.45) -> DataFrame:
    """Per group: cells above the threshold, missing ones, and whether they are too many for a sparse list."""
    positive, missing, n = F.count_if(F.col("value") > threshold), F.count_if(F.col("value").isNull()), F.count(F.lit(1))
    return fields.groupBy(*keys).agg(positive.alias("positive"), missing.alias("missing"), ((positive + missing) > n * dense).alias("dense"))


def ice_environment(levels: DataFrame) -> DataFrame:
    """``levels`` (t, td, rh, u, v near the ground) with wet_bulb_c and wind_kt; the dewpoint is taken from rh where td is missing."""
    dew = F.coalesce("td", thermo.dewpoint_from_rh(F.col("t"), F.col("rh")))
    wind = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")) * MPS_TO_KT
    return levels.withColumns({"wet_bulb_c": thermo.wet_bulb_c(F.col("t"), dew), "wind_kt": wind})


def environment_segments(chunks: DataFrame, hours: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """keys, start_hour, end_hour, hour, weight: the sampled hours of each chunk and the share of it each stands for.

    An hour stands for the time since the sample before it, or since the start. A
    chunk without samples takes its end hour whole.
    """
    inside = chunks.select(*keys, "start_hour", "end_hour", F.explode(F.sequence(F.col("start_hour") + 1, F.col("end_hour"))).alias("hour"))
    sampled = inside.join(hours.select(*keys, "hour").distinct(), [*keys, "hour"])
    order = Window.partitionBy(*keys, "start_hour", "end_hour").orderBy("hour")
    weight = (F.col("hour") - F.coalesce(F.lag("hour").over(order), F.col("start_hour"))) / (F.col("end_hour") - F.col("start_hour"))
    found = sampled.withColumn("weight", weight).select(*keys, "start_hour", "end_hour", "hour", "weight")
    none = chunks.select(*keys, "start_hour", "end_hour").distinct().join(found.select(*keys, "start_hour", "end_hour").distinct(), [*keys, "start_hour", "end_hour"], "left_anti")
    return found.unionByName(none.select(*keys, "start_hour", "end_hour", F.col("end_hour").alias("hour"), F.lit(1.0).alias("weight")))
