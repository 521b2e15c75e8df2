"""Labels along contour lines, so that each line has one where there is room.

Candidate places are found by Spark: points at fixed shares of a line's length, the
middle first.  Placing is greedy and so needs a frame's candidates in order, a
few for each of its lines; collisions are looked up in a grid of squares as wide as the
spacing, so a place is compared with its neighbourhood only.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Shares of a line's length at which a label may stand, in order of preference.
SHARES = (0.5, 0.25, 0.75, 0.375, 0.625, 0.125, 0.875)


class Room:
    """Placed labels, by squares of the spacing."""

    def __init__(self, spacing: float):
        self.spacing, self.squares = spacing, defaultdict(list)

    def _square(self, x: float, y: float) -> tuple[int, int]:
        return math.floor(x / self.spacing), math.floor(y / self.spacing)

    def free(self, x: float, y: float) -> bool:
        """Whether no label is nearer than the spacing."""
        a, b = self._square(x, y)
        near = (p for i in (a - 1, a, a + 1) for j in (b - 1, b, b + 1) for p in self.squares.get((i, j), ()))
        return all(math.hypot(x - p[0], y - p[1]) >= self.spacing for p in near)

    def place(self, x: float, y: float) -> None:
        self.squares[self._square(x, y)].append((x, y))


def candidates(points: DataFrame, keys: tuple[str, ...] = ("frame",), shares: tuple[float, ...] = SHARES) -> DataFrame:
    """keys, line, value, turn, x, y, angle: the places for each line's label.

    points: keys, line, value, place (order along the line), x and y. A place lies on the
    segment where the length so far reaches its share; angle is the segment's, in
    degrees within -90 to 90. Lines without length have no place.
    """
    line = Window.partitionBy(*keys, "line")
    along = line.orderBy("place")
    steps = points.withColumns({"x2": F.lead("x").over(along), "y2": F.lead("y").over(along)}).where("x2 IS NOT NULL")
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    steps = steps.withColumn("size", F.sqrt(dx * dx + dy * dy))
    steps = steps.withColumns({"upto": F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, 0)), "whole": F.sum("size").over(line)}).where("size > 0")
    wanted = F.posexplode(F.array(*[F.lit(s) for s in shares])).alias("turn", "share")
    rows = steps.select("*", wanted).withColumn("at", F.col("share") * F.col("whole"))
    begin = F.col("upto") - F.col("size")
    rows = rows.where((F.col("at") > begin) & (F.col("at") <= F.col("upto"))).withColumn("part", (F.col("at") - begin) / F.col("size"))
    angle = F.degrees(F.atan2(F.col("y2") - F.col("y"), F.col("x2") - F.col("x")))
    flat = F.when(angle > 90, angle - 180).when(angle <= -90, angle + 180).otherwise(angle)
    return rows.select(*keys, "line", "value", "turn", (F.col("x") + (F.col("x2") - F.col("x")) * F.col("part")).alias("x"), (F.col("y") + (F.col("y2") - F.col("y")) * F.col("part")).alias("y"), flat.alias("angle"))


def place_labels(batches: Iterator[pa.RecordBatch], spacing: float, keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The first free place of each line; lines without room have none.

    Rows come in the order of keys, line and turn, a frame's standing labels (turn -1) before its lines, and are
    not given back. Only the labels of one frame are held.
    """
    frame, room, named = None, Room(spacing), None
    for batch in batches:
        chosen, columns = [], [batch.column(c).to_pylist() for c in ("line", "turn", "x", "y")]
        whose = zip(*[batch.column(c).to_pylist() for c in keys], strict=True)
        for k, (key, line, turn, x, y) in enumerate(zip(whose, *columns, strict=True)):
            if key != frame:
                frame, room, named = key, Room(spacing), None
            if turn < 0:
                room.place(x, y)
            elif (line,) != named and room.free(x, y):
                room.place(x, y)
                named = (line,)
                chosen.append(k)
        if chosen:
            yield batch.take(pa.array(chosen))


def line_labels(points: DataFrame, spacing: float, bounds: tuple[float, float, float, float], taken: DataFrame | None = None, keys: tuple[str, ...] = ("frame",), reach: float = 1.0) -> DataFrame:
    """keys, line, value, x, y, angle: one label for each line that has none yet, where there is room.

    bounds: least x, least y, most x and most y of a label. taken: keys, value, x, y of labels that
    stand already; a line with one of its value within ``reach`` of one of its points
    needs no other. A frame's candidates, a few for each of its lines, pass one task in their order.
    """
    x0, y0, x1, y1 = bounds
    rows = candidates(points, keys).where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    place = lambda given: given.repartition(*keys).sortWithinPartitions(*keys, F.col("turn") >= 0, "line", "turn").mapInArrow(lambda part: place_labels(part, spacing, keys), rows.schema).drop("turn")
    if taken is None:
        return place(rows)
    # labels and points within reach share a square or stand in neighbouring ones
    square = lambda c: F.floor(F.col(c) / reach)
    spots = taken.select(*keys, "value", F.col("x").alias("tx"), F.col("y").alias("ty"))
    spots = spots.withColumn("sx", F.explode(F.sequence(square("tx") - 1, square("tx") + 1))).withColumn("sy", F.explode(F.sequence(square("ty") - 1, square("ty") + 1)))
    near = points.withColumns({"sx": square("x"), "sy": square("y")}).join(spots, [*keys, "value", "sx", "sy"])
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    named = near.where(dx * dx + dy * dy <= reach * reach).select(*keys, "line").distinct()
    rows = rows.join(named, [*keys, "line"], "left_anti").select(*rows.columns)
    others = taken.select(*[F.col(c) if c in keys else F.col(c).cast("double") if c in ("x", "y") else F.lit(-1 if c == "turn" else None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    return place(rows.unionByName(others))
