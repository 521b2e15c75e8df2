"""Contours by marching squares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nimbostrat.operators.stencil import along_row

# Crossed edges (0 top, 1 right, 2 bottom, 3 left) by case; saddles apart.
SEGMENTS = {1: [(3, 0)], 2: [(0, 1)], 3: [(3, 1)], 4: [(1, 2)], 6: [(0, 2)], 7: [(3, 2)], 8: [(2, 3)], 9: [(0, 2)], 11: [(1, 2)], 12: [(3, 1)], 13: [(0, 1)], 14: [(3, 0)]}
SADDLES = {(5, True): [(0, 1), (2, 3)], (5, False): [(3, 0), (1, 2)], (10, True): [(3, 0), (1, 2)], (10, False): [(0, 1), (2, 3)]}


def corners(grid: DataFrame, value: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells with their corner values a, b, c, d, clockwise from the north-west; complete ones only."""
    below = Window.partitionBy(*keys, "col").orderBy("row")
    right = grid.select(*keys, "row", "col", F.col(value).alias("a"), F.lead(value).over(along_row(keys)).alias("b"))
    cells = right.withColumns({"d": F.lead("a").over(below), "c": F.lead("b").over(below)})
    return cells.where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL")


def cases(grid: DataFrame, levels: list[float], value: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """Corners by level with their case number; uncrossed cells are left out."""
    high = lambda c, w: F.when(F.col(c) >= F.col("level"), w).otherwise(0)
    number = high("a", 1) + high("b", 2) + high("c", 4) + high("d", 8)
    # a level can only cross a cell between its extremes
    near = F.filter(F.array(*[F.lit(float(x)) for x in levels]), lambda x: (x <= F.greatest("a", "b", "c", "d")) & (x > F.least("a", "b", "c", "d")))
    return corners(grid, value, keys).select("*", F.explode(near).alias("level")).withColumn("case", number).where("case NOT IN (0, 15)")


def _point(edge: Column) -> Column:
    """Where the level crosses an edge, in grid coordinates."""
    share = lambda p, q: F.when(F.col(q) == F.col(p), 0.5).otherwise(F.try_divide(F.col("level") - F.col(p), F.col(q) - F.col(p)))
    x = F.when(edge == 0, F.col("col") + share("a", "b")).when(edge == 1, F.col("col") + 1.0).when(edge == 2, F.col("col") + share("d", "c")).otherwise(F.col("col") + 0.0)
    y = F.when(edge == 0, F.col("row") + 0.0).when(edge == 1, F.col("row") + share("b", "c")).when(edge == 2, F.col("row") + 1.0).otherwise(F.col("row") + share("a", "d"))
    return F.struct(x.alias("x"), y.alias("y"))


def segments(grid: DataFrame, levels: list[float], value: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, level, row, col and the ends x1, y1, x2, y2 of each line through a cell."""
    pair = lambda p: F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in p])
    centre = (F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4 >= F.col("level")
    chain = F
    for number, pairs in SEGMENTS.items():
        chain = chain.when(F.col("case") == number, pair(pairs))
    for (number, high), pairs in SADDLES.items():
        chain = chain.when((F.col("case") == number) & (centre if high else ~centre), pair(pairs))
    lines = cases(grid, levels, value, keys).select("*", F.explode(chain).alias("e"))
    ends = lines.select("*", _point(F.col("e.a")).alias("p"), _point(F.col("e.b")).alias("q"))
    return ends.select(*keys, "level", "row", "col", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))


def longest_by_value(lines: DataFrame, n: int, keys: tuple[str, ...]) -> DataFrame:
    """The ``n`` longest lines for each of ``keys``; equal lengths by line number."""
    order = Window.partitionBy(*keys).orderBy(F.desc("length"), "line")
    return lines.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
