"""Values on their way to a picture: visible ranges, colours, levels and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nimbostrat.functions.units import MPS_TO_MPH, quantise, step_of


def scale_of(unit: Column) -> Column:
    """The quantisation step of a unit."""
    return step_of(F.trim(unit))


def quantised(value: Column, scale: Column) -> Column:
    """A 16-bit step number, halves up, clamped; missing values have a number of their own."""
    return quantise(value, scale).cast("int")


def quantised_wind(u: Column, v: Column, scale: Column, factor: float = MPS_TO_MPH) -> Column:
    """The step number of a wind's speed; missing unless both components are known."""
    return quantised(F.sqrt(u * u + v * v) * factor, scale)


def in_range(value: Column, low: Column, high: Column) -> Column:
    """Whether a known value lies within bounds, of which either may be missing."""
    return F.coalesce(value.isNotNull() & F.coalesce(value >= low, F.lit(True)) & F.coalesce(value <= high, F.lit(True)), F.lit(False))


def gates(fields: DataFrame, least: list[int], keys: tuple[str, ...], value: str = "value") -> DataFrame:
    """keys, gate, visible: for each threshold the cells that are shown from it on."""
    counts = [F.struct(F.lit(g).alias("gate"), F.count_if(F.col(value) >= g).alias("visible")) for g in least]
    return fields.groupBy(*keys).agg(F.array(*counts).alias("x")).select(*keys, F.explode("x").alias("x")).select(*keys, "x.gate", "x.visible")


def type_bin(value: Column, lows: Column, highs: Column) -> Column:
    """The bin of a value (from 0) among ascending lower bounds with upper bounds of their own.

    A value below all lower bounds falls in the first bin; beyond a bin's upper
    bound, the last one's excepted, it has none (-1).
    """
    k = F.greatest(F.size(F.filter(lows, lambda x: x <= value)), F.lit(1)) - 1
    inside = (k == F.size(lows) - 1) | (value < F.try_element_at(highs, k + 1))
    return F.when(value.isNotNull() & (F.size(lows) > 0), F.when(inside, k).otherwise(-1))


def uniform_steps(thresholds: Column) -> Column:
    """A struct of start and scale where at least three thresholds are evenly spaced, else missing."""
    step = F.get(thresholds, F.lit(1)) - F.get(thresholds, F.lit(0))
    gaps = F.zip_with(F.slice(thresholds, 2, F.size(thresholds)), F.slice(thresholds, 1, F.size(thresholds) - 1), lambda b, a: b - a)
    even = F.forall(gaps, lambda d: F.abs(d - step) <= F.greatest(F.lit(1e-9), F.abs(step) * 1e-6))
    return F.when((F.size(thresholds) >= 3) & (step > 0) & even, F.struct(F.get(thresholds, F.lit(0)).alias("start"), (1.0 / step).alias("scale")))


def blend(left: tuple, right: tuple, share: Column) -> Column:
    """Red, green, blue (0..255) and alpha (0..1) between two colours (r, g, b, a), weighted by alpha."""
    la, ra = left[3], right[3]
    alpha = la + (ra - la) * share

    def part(k: int) -> Column:
        mixed = (left[k] * la + (right[k] * ra - left[k] * la) * share) / alpha
        clear = F.when(share < 0.5, float(left[k])).otherwise(float(right[k]))
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.when(alpha <= 1e-9, clear).otherwise(mixed))) + 0.5).cast("int")

    return F.struct(*[part(k).alias(c) for k, c in enumerate("rgb")], F.when(alpha <= 1e-9, 0.0).otherwise(alpha).alias("a"))


def colour_at(stops: list[tuple], position: Column) -> Column:
    """The colour at a position (clamped to 0..1) among stops (at, r, g, b, a) that ascend; at a hard break the later stop."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), position))
    out = F.when(position.isNull(), None)
    for left, right in zip(stops, stops[1:], strict=False):
        if right[0] - left[0] > 1e-12:
            out = out.when(t < right[0] - 1e-12, blend(left[1:], right[1:], F.greatest(F.lit(0.0), (t - left[0]) / (right[0] - left[0]))))
    return out.otherwise(blend(stops[-1][1:], stops[-1][1:], F.lit(0.0)))


def stepped_levels(low: Column, high: Column, step: Column) -> Column:
    """Levels from ``low`` on, every ``step`` up to ``high``; none where the range or the step is empty."""
    n = F.floor((high - low) / step + 0.001).cast("int")
    levels = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda k: F.round(low + k * step, 6))
    return F.when((step > 0) & (high >= low), levels).otherwise(F.array().cast("array<double>"))


def contour_levels(low: Column, high: Column, step: Column, most: int = 512) -> Column:
    """The multiples of ``step`` within a range, the first ``most`` of them."""
    first, last = F.ceil(low / step) * step, F.floor(high / step) * step
    return F.slice(stepped_levels(first.cast("double"), last.cast("double"), step), 1, most)


def line_midpoints(points: DataFrame, keys: tuple[str, ...] = ("line",)) -> DataFrame:
    """keys, x, y, angle: the point halfway along each line and the direction in degrees of its segment.

    points: keys, k (the order), x, y. Lines without length are left out.
    """
    order = Window.partitionBy(*keys).orderBy("k")
    dx, dy = F.lead("x").over(order) - F.col("x"), F.lead("y").over(order) - F.col("y")
    parts = points.withColumns({"dx": dx, "dy": dy}).where("dx IS NOT NULL").withColumn("size", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumns({"upto": upto, "half": F.sum("size").over(Window.partitionBy(*keys)) / 2}).where("size > 0 AND upto >= half")
    share = (F.col("half") - (F.col("upto") - F.col("size"))) / F.col("size")
    at = F.struct((F.col("x") + F.col("dx") * share).alias("x"), (F.col("y") + F.col("dy") * share).alias("y"), F.degrees(F.atan2("dy", "dx")).alias("angle"))
    return parts.groupBy(*keys).agg(F.min_by(at, "k").alias("m")).select(*keys, "m.x", "m.y", "m.angle")


def grid_spacing_km(north: float, south: float, east: float, west: float, cols: int, rows: int) -> float:
    """Mean spacing of a raster, at least 4 km; 25 where it has no extent."""
    import math

    if cols < 2 or rows < 2:
        return 25.0
    lat = abs(north - south) * 111.0 / (rows - 1)
    lon = abs(east - west) * 111.0 * max(0.2, math.cos(math.radians((north + south) / 2))) / (cols - 1)
    return max(4.0, (lat + lon) / 2)


def global_extrema(grid: DataFrame, rows: int, cols: int, keys: tuple[str, ...] = (), value: str = "v") -> DataFrame:
    """keys, kind, row, col, value: the highest and the lowest cell inside the margin, the first in reading order of equals."""
    margin = max(2, min(8, int(min(rows, cols) / 28 + 0.5)))
    inside = grid.where(F.col("row").between(margin, rows - margin - 1) & F.col("col").between(margin, cols - margin - 1) & F.col(value).isNotNull())
    cell = F.struct("row", "col", F.col(value).alias("value"))
    best = inside.groupBy(*keys).agg(F.min_by(cell, F.struct(-F.col(value), "row", "col")).alias("high"), F.min_by(cell, F.struct(value, "row", "col")).alias("low"))
    pairs = best.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("x")) for k in ("high", "low")])).alias("p"))
    return pairs.where("p.x IS NOT NULL").select(*keys, "p.kind", "p.x.row", "p.x.col", "p.x.value")


def refined(centres: DataFrame, grid: DataFrame, radius: int = 2, value: str = "v") -> DataFrame:
    """centres (kind, row, col) moved to the raw extreme within ``radius`` cells, with its value.

    The centre itself wins over equals, then the first in reading order.
    """
    near = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    spread = centres.select("kind", F.col("row").alias("r0"), F.col("col").alias("c0"), near.alias("dr")).select("*", near.alias("dc"))
    spread = spread.withColumns({"row": F.col("r0") + F.col("dr"), "col": F.col("c0") + F.col("dc")})
    found = spread.join(grid.where(F.col(value).isNotNull()).select("row", "col", F.col(value).alias("value")), ["row", "col"])
    order = F.struct(F.when(F.col("kind") == "low", F.col("value")).otherwise(-F.col("value")).alias("v"), ((F.col("dr") != 0) | (F.col("dc") != 0)).alias("moved"), "row", "col")
    best = found.groupBy("kind", "r0", "c0").agg(F.min_by(F.struct("row", "col", "value"), order).alias("x"))
    return best.select("kind", F.col("r0").alias("row"), F.col("c0").alias("col"), F.col("x.row").alias("to_row"), F.col("x.col").alias("to_col"), "x.value")


def apart(centres: DataFrame, distance: int, mean: float = 1013.25) -> DataFrame:
    """centres (kind, row, col, value, prominence) with ``kept``: of a high and a low nearer than ``distance`` the stronger.

    A centre is dropped when any stronger one of the other kind is near; equals
    favour the high. Strength is the distance from the mean pressure and the
    prominence. Buckets of ``distance`` cells make the search an equi-join.
    """
    strength = F.abs(F.col("value") - mean) + F.greatest(F.lit(0.0), F.coalesce("prominence", F.lit(0.0)))
    rows = centres.withColumns({"strength": strength, "br": F.floor(F.col("row") / distance), "bc": F.floor(F.col("col") / distance)})
    step = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    mine = rows.select("*", step.alias("i")).select("*", step.alias("j")).withColumns({"br": F.col("br") + F.col("i"), "bc": F.col("bc") + F.col("j")})
    other = rows.select(F.col("kind").alias("k2"), F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("strength").alias("s2"), "br", "bc")
    close = (F.col("k2") != F.col("kind")) & ((F.col("row") - F.col("r2")) ** 2 + (F.col("col") - F.col("c2")) ** 2 < distance * distance)
    stronger = F.when(F.col("kind") == "high", F.col("s2") > F.col("strength")).otherwise(F.col("s2") >= F.col("strength"))
    beaten = mine.join(other, ["br", "bc"]).where(close & stronger).select("kind", "row", "col").distinct().withColumn("beaten", F.lit(True))
    return centres.join(beaten, ["kind", "row", "col"], "left").withColumn("kept", F.col("beaten").isNull()).drop("beaten")
