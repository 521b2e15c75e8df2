"""Stencils over gridded cells: neighbours in rows and columns.

A field is a table of ``keys`` (frame columns, may be empty), row, col and a
value; row 0 is north.  One-axis neighbours are windows within a row or a
column of a frame, so no window holds more than one line of a grid.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nimbostrat.functions.mercator import Bounds, coriolis, row_latitude
from nimbostrat.functions.missing import floor_at
from nimbostrat.functions.thermo import KAPPA

EARTH_RADIUS = 6_371_000.0
BINOMIAL = (1.0, 4.0, 6.0, 4.0, 1.0)


def along_row(keys: tuple[str, ...]) -> Window:
    return Window.partitionBy(*keys, "row").orderBy("col")


def along_column(keys: tuple[str, ...]) -> Window:
    return Window.partitionBy(*keys, "col").orderBy("row")


def taps(value: Column, window, weights: tuple[float, ...], missing_edges: bool = False) -> Column:
    """Weighted mean of the cells around each one, over those present.

    The grid must be complete: missing cells are rows with null values.
    """
    radius = len(weights) // 2
    total = norm = F.lit(0.0)
    for k, w in enumerate(weights):
        step = k - radius
        tap = value if step == 0 else F.lag(value, -step).over(window) if step < 0 else F.lead(value, step).over(window)
        total = total + F.coalesce(tap * w, F.lit(0.0))
        norm = norm + F.when(tap.isNotNull(), w).otherwise(0.0)
    return F.when(norm > 0, F.try_divide(total, norm))


def smooth(grid: DataFrame, passes: int = 1, value: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """Non-negative 1-4-6-4-1 smoothing; cells missing at first stay missing."""
    out = grid.withColumn("s", F.col(value))
    for _ in range(passes):
        out = out.withColumn("s", F.when(F.col(value).isNotNull(), taps(F.col("s"), along_row(keys), BINOMIAL)))
        out = out.withColumn("s", F.when(F.col(value).isNotNull(), floor_at(taps(F.col("s"), along_column(keys), BINOMIAL), 0.0)))
    return out.withColumnRenamed("s", "smoothed")


def gaussian_weights(sigma: float, radius: int | None = None) -> tuple[float, ...]:
    r = radius if radius is not None else max(1, math.ceil(3 * sigma))
    return tuple(math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-r, r + 1))


def gaussian_blur(grid: DataFrame, sigma: float, radius: int | None = None, value: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """Separable Gaussian blur over the present cells."""
    weights = gaussian_weights(sigma, radius)
    rows = grid.withColumn("b", taps(F.col(value), along_row(keys), weights))
    return rows.withColumn("blurred", taps(F.col("b"), along_column(keys), weights)).drop("b")


def frontogenesis(cells: DataFrame, bounds: Bounds, rows: int, cols: int, pressure: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Petterssen frontogenesis in K/100 km/3 h of cells with t, u and v; edges are missing."""
    theta = F.col("t") * (1000.0 / pressure) ** KAPPA
    cells = cells.withColumn("theta", theta)
    lat = row_latitude(F.col("row"), rows, bounds)
    dx = 2 * EARTH_RADIUS * F.cos(F.radians(lat)) * math.radians(bounds.east - bounds.west) / (cols - 1)
    north, south = row_latitude(F.col("row") - 1, rows, bounds), row_latitude(F.col("row") + 1, rows, bounds)
    dy = EARTH_RADIUS * F.abs(F.radians(north) - F.radians(south))
    across, down = along_row(keys), along_column(keys)
    for name in ("theta", "u", "v"):
        cells = cells.withColumn(f"{name}_x", (F.lead(name).over(across) - F.lag(name).over(across)) / dx)
    for name in ("theta", "u", "v"):
        cells = cells.withColumn(f"{name}_y", (F.lag(name).over(down) - F.lead(name).over(down)) / dy)
    tx, ty = F.col("theta_x"), F.col("theta_y")
    size = F.sqrt(tx * tx + ty * ty)
    stretch, shear, divergence = F.col("u_x") - F.col("v_y"), F.col("v_x") + F.col("u_y"), F.col("u_x") + F.col("v_y")
    value = -0.5 * ((tx * tx - ty * ty) * stretch + 2.0 * tx * ty * shear + size * size * divergence) * (1e5 * 10800.0)
    inner = cells.withColumn("size", size).withColumn("frontogenesis", F.when(size >= 1e-12, F.try_divide(value, size)))
    return inner.drop("theta", "size", *[f"{n}_{a}" for n in ("theta", "u", "v") for a in "xy"])


def relative_vorticity(cells: DataFrame, bounds: Bounds, rows: int, value: str = "v") -> DataFrame:
    """(absolute vorticity - f) in 1e-5/s."""
    return cells.withColumn("relative", (F.col(value) - coriolis(row_latitude(F.col("row"), rows, bounds))) * 1e5)


def extrema(grid: DataFrame, reach: int = 4, value: str = "v", keys: tuple[str, ...] = (), least: float = 0.04, slack: float = 0.03) -> DataFrame:
    """Cells that no cell of their square neighbourhood exceeds (high) or undercuts (low).

    The neighbourhood must be complete and vary by more than ``least``.
    """
    across, down = along_row(keys).rowsBetween(-reach, reach), along_column(keys).rowsBetween(-reach, reach)
    side = 2 * reach + 1
    lines = grid.withColumns({"n1": F.count(value).over(across), "hi1": F.max(value).over(across), "lo1": F.min(value).over(across)})
    full = lines.withColumns({"n": F.sum("n1").over(down), "hi": F.max("hi1").over(down), "lo": F.min("lo1").over(down)})
    v = F.col(value)
    kind = F.when((v >= F.col("hi") - slack) & (v - F.col("lo") > least), "high").when((v <= F.col("lo") + slack) & (F.col("hi") - v > least), "low")
    return full.where(F.col("n") == side * side).withColumn("kind", kind).where("kind IS NOT NULL").drop("n1", "hi1", "lo1", "n", "hi", "lo")


def presentation(grid: DataFrame, passes: int = 1, value: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """``smooth`` of the positive part: negative values count as 0, missing ones stay missing."""
    return smooth(grid.withColumn(value, floor_at(F.col(value), 0.0)), passes, value, keys)
