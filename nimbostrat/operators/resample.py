"""Resampling, remapping, sampling and statistics of grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nimbostrat.functions.mercator import Bounds, mercator_y
from nimbostrat.functions.missing import poison_sum, renormalised


def _taps(points: DataFrame, grid: DataFrame, rows: int, cols: int, value: str, keys: tuple[str, ...]) -> DataFrame:
    """points (point, fx, fy) with their four cells and weights, one row each."""
    x0, y0 = F.least(F.floor("fx"), F.lit(cols - 1)), F.least(F.floor("fy"), F.lit(rows - 1))
    x1, y1 = F.least(x0 + 1, F.lit(cols - 1)), F.least(y0 + 1, F.lit(rows - 1))
    tx, ty = F.col("fx") - x0, F.col("fy") - y0
    tap = lambda x, y, w: F.struct(x.cast("int").alias("col"), y.cast("int").alias("row"), w.alias("w"))
    four = F.array(tap(x0, y0, (1 - tx) * (1 - ty)), tap(x1, y0, tx * (1 - ty)), tap(x0, y1, (1 - tx) * ty), tap(x1, y1, tx * ty))
    spread = points.select("*", F.explode(four).alias("tap")).where("tap.w > 0").select("*", "tap.col", "tap.row", "tap.w").drop("tap")
    cells = grid.select(*keys, "row", "col", F.col(value).alias("cell_value"))
    return spread.join(cells, [*keys, "row", "col"], "left")


def sample(points: DataFrame, grid: DataFrame, rows: int, cols: int, value: str = "v", keys: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """Bilinear values at (fx, fy); points outside the grid are left out.

    strict: any missing cell of the four makes the value missing; otherwise the
    weights of the present ones are scaled up.
    """
    inside = points.where(F.col("fx").between(0, cols - 1) & F.col("fy").between(0, rows - 1))
    taps = _taps(inside, grid, rows, cols, value, keys)
    v, w = F.col("cell_value"), F.col("w")
    return taps.groupBy(*keys, "point").agg((poison_sum(v, w) if strict else renormalised(v, w)).alias("value"))


def resample_points(grid: DataFrame, rows: int, cols: int, new_rows: int, new_cols: int) -> DataFrame:
    """Positions of a new raster's cells on the old one."""
    spark = grid.sparkSession
    cells = spark.range(new_rows * new_cols).select(F.col("id").alias("point"), F.floor(F.col("id") / new_cols).alias("y"), (F.col("id") % new_cols).alias("x"))
    # rounding may put the last one beyond the edge
    scale = lambda c, new, old: F.least(F.col(c) * ((old - 1) / max(new - 1, 1)), F.lit(old - 1.0))
    return cells.select("point", scale("x", new_cols, cols).alias("fx"), scale("y", new_rows, rows).alias("fy"))


def mercator_source_row(row: Column, rows: int, bounds: Bounds) -> Column:
    """The row of a latitude-spaced grid (row 0 south) below a Mercator-spaced raster row (row 0 north)."""
    from nimbostrat.functions.mercator import row_latitude

    return (row_latitude(row, rows, bounds) - bounds.south) / (bounds.north - bounds.south) * (rows - 1)


def mercator_remap(grid: DataFrame, rows: int, bounds: Bounds, nearest: bool = False, value: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """Latitude-spaced rows (south first) onto Mercator-spaced rows (north first).

    Linear between the two source rows, over those present; or the nearest row.
    """
    spark = grid.sparkSession
    target = spark.range(rows).select(F.col("id").cast("int").alias("row")).withColumn("y", F.greatest(F.lit(0.0), F.least(F.lit(rows - 1.0), mercator_source_row(F.col("row"), rows, bounds))))
    if nearest:
        plan = target.select("row", F.floor(F.col("y") + 0.5).cast("int").alias("source"), F.lit(1.0).alias("w"))
    else:
        low = F.least(F.floor("y"), F.lit(max(rows - 2, 0))).cast("int")
        t = F.col("y") - low
        plan = target.select("row", F.explode(F.array(F.struct(low.alias("s"), (1 - t).alias("w")), F.struct((low + 1).alias("s"), t.alias("w")))).alias("p")).select("row", F.col("p.s").alias("source"), F.col("p.w").alias("w")).where("w > 0")
    cells = grid.select(*keys, F.col("row").alias("source"), "col", F.col(value).alias("cell_value"))
    return cells.join(plan, "source").groupBy(*keys, "row", "col").agg(renormalised(F.col("cell_value"), F.col("w")).alias("value"))


def position(latitude: Column, longitude: Column, rows: int, cols: int, bounds: Bounds) -> tuple[Column, Column]:
    """(fx, fy) of a place: linear in longitude, Mercator in latitude."""
    top, bottom = mercator_y(F.lit(bounds.north)), mercator_y(F.lit(bounds.south))
    fx = (longitude - bounds.west) / (bounds.east - bounds.west) * (cols - 1)
    fy = (top - mercator_y(latitude)) / (top - bottom) * (rows - 1)
    return fx, fy


def nearest_rank_stats(grid: DataFrame, value: str = "v", keys: tuple[str, ...] = (), top: float | None = None, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """n, min, max, percentiles by index round((n-1)p), and the share at or above ``top``.

    Values are counted before they are ordered, and ranks run over the distinct
    ones of a group, so equal values cost nothing.
    """
    group = list(keys) or [F.lit(0).alias("all")]
    counts = grid.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    names = list(keys) or ["all"]
    order = Window.partitionBy(*names).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("c").over(order))
    n = counts.groupBy(*names).agg(F.sum("c").alias("n"))
    joined = ranked.join(n, names)
    index = lambda p: F.floor((F.col("n") - 1) * p + 0.5)
    out = [F.first("n").alias("n"), F.min("x").alias("min"), F.max("x").alias("max")]
    out += [F.min(F.when(F.col("upto") > index(p), F.col("x"))).alias(f"p{round(p * 100)}") for p in shares]
    if top is not None:
        out.append((100.0 * F.sum(F.when(F.col("x") >= top, F.col("c")).otherwise(0)) / F.first("n")).alias("clamp_percent"))
    return joined.groupBy(*names).agg(*out).drop(*([] if keys else ["all"]))


def step_bins(grid: DataFrame, bins: list[tuple[float, str]], value: str = "v") -> DataFrame:
    """The bin of the largest threshold at or below each value; below all, the first."""
    ordered = sorted(bins)
    chain = F
    for (_, name), (upper, _) in zip(ordered, ordered[1:], strict=False):
        chain = chain.when(F.col(value) < upper, name)
    chosen = chain.otherwise(ordered[-1][1]) if len(ordered) > 1 else F.lit(ordered[0][1])
    return grid.withColumn("bin", F.when(F.col(value).isNotNull(), chosen))


def table_index(value: Column, low: float, high: float, size: int) -> Column:
    """Index into a colour table of ``size`` entries, linear between two values."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
    return F.when(value.isNotNull(), F.floor(share * (size - 1) + 0.5)).cast("int")
