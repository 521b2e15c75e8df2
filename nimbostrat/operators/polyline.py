"""Lines out of contour segments: stitching, thinning, smoothing, encoding.

Order-dependent geometry runs in Python over the segments of one level of one
frame at a time; lengths and areas are plain aggregates.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Point = tuple[float, float]
DIGITS = 6  # ends that agree to so many digits are one point


def stitch(segments: list[tuple[Point, Point]]) -> list[list[Point]]:
    """Chains of segments that share ends, in order of their first segment."""
    key = lambda p: (round(p[0], DIGITS), round(p[1], DIGITS))
    at = defaultdict(list)
    for k, ends in enumerate(segments):
        for p in ends:
            at[key(p)].append(k)
    free, lines = [True] * len(segments), []

    def follow(line: list[Point]) -> None:
        while nxt := next((k for k in at[key(line[-1])] if free[k]), None):
            free[nxt] = False
            a, b = segments[nxt]
            line.append(b if key(a) == key(line[-1]) else a)

    for k, (a, b) in enumerate(segments):
        if free[k]:
            free[k] = False
            line = [a, b]
            follow(line)
            line.reverse()
            follow(line)
            lines.append(line)
    return lines


def thin(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Ramer-Douglas-Peucker: the points that deviate by more than the tolerance."""
    keep, spans = {0, len(points) - 1}, [(0, len(points) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        base = points[b] - points[a]
        offset = points[a + 1 : b] - points[a]
        size = np.hypot(*base)
        apart = np.abs(base[0] * offset[:, 1] - base[1] * offset[:, 0]) / size if size else np.hypot(offset[:, 0], offset[:, 1])
        k = int(apart.argmax())
        if apart[k] > tolerance:
            keep.add(a + 1 + k)
            spans += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[sorted(keep)]


def cut_corners(points: np.ndarray) -> np.ndarray:
    """One pass of Chaikin smoothing; the ends stay."""
    if len(points) < 3:
        return points
    a, b = points[:-1], points[1:]
    inner = np.stack([0.75 * a + 0.25 * b, 0.25 * a + 0.75 * b], axis=1).reshape(-1, 2)
    return np.concatenate([points[:1], inner[1:-1], points[-1:]])


def stitched_lines(segments: DataFrame, keys: tuple[str, ...], tolerance: float = 0.28, passes: int = 1, least: float = 6.0) -> DataFrame:
    """keys, line, place, x, y of the lines of at least ``least`` cells, thinned and smoothed."""
    kinds = ", ".join(f"`{k}` {segments.schema[k].dataType.simpleString()}" for k in keys)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["row", "col", "x1", "y1", "x2", "y2"])
        pairs = [((a, b), (c, d)) for a, b, c, d in ordered[["x1", "y1", "x2", "y2"]].itertuples(index=False)]
        out, number = [], 0
        for line in stitch(pairs):
            points = np.array(line)
            if np.hypot(*np.diff(points, axis=0).T).sum() < least:
                continue
            points = thin(points, tolerance)
            for _ in range(passes):
                points = cut_corners(points)
            out.append(pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "line": number, "place": range(len(points)), "x": points[:, 0], "y": points[:, 1]}))
            number += 1
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in [*keys, "line", "place", "x", "y"]})

    return segments.groupBy(*keys).applyInPandas(one, f"{kinds}, line int, place int, x double, y double")


def lengths_and_areas(points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, points, length and shoelace area of lines given by place, x and y."""
    order = Window.partitionBy(*keys).orderBy("place")
    nxt = points.withColumns({"x2": F.lead("x").over(order), "y2": F.lead("y").over(order)})
    step = F.sqrt((F.col("x2") - F.col("x")) ** 2 + (F.col("y2") - F.col("y")) ** 2)
    first = F.min_by(F.struct("x", "y"), "place")
    last = F.max_by(F.struct("x", "y"), "place")
    cross = F.coalesce(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")), F.lit(0.0))
    rows = nxt.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.coalesce(F.sum(step), F.lit(0.0)).alias("length"), cross.alias("cross"), first.alias("a"), last.alias("b"))
    closing = F.col("b.x") * F.col("a.y") - F.col("a.x") * F.col("b.y")
    return rows.select(*keys, "points", "length", (F.abs(F.col("cross") + closing) / 2).alias("area"))


def encode_polyline(points: list[Point], digits: int = 5) -> str:
    """Differences of rounded (lat, lon), zig-zagged, in printable groups of five bits."""
    out, before = [], (0, 0)
    for point in points:
        now = tuple(int(np.floor(c * 10**digits + 0.5)) for c in point)
        for a, b in zip(now, before, strict=True):
            v = (a - b) << 1 if a >= b else ~((a - b) << 1)
            while v >= 0x20:
                out.append(chr((0x20 | v & 0x1F) + 63))
                v >>= 5
            out.append(chr(v + 63))
        before = now
    return "".join(out)


def decode_polyline(text: str, digits: int = 5) -> list[Point]:
    values, value, shift = [], 0, 0
    for c in text:
        code = ord(c) - 63
        value |= (code & 0x1F) << shift
        shift += 5
        if code < 0x20:
            values.append(~(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    sums = np.cumsum(np.array(values, np.int64).reshape(-1, 2), axis=0) / 10**digits
    return [tuple(p) for p in sums.tolist()]


def _groups(value: Column) -> Column:
    """A number, zig-zagged, in printable groups of five bits, the lowest first."""
    v = F.when(value >= 0, F.shiftleft(value, 1)).otherwise(F.bitwise_not(F.shiftleft(value, 1)))
    n = F.ceil(F.length(F.bin(v)) / 5).cast("int")
    code = lambda k: F.call_function("shiftrightunsigned", v, k * 5).bitwiseAND(F.lit(31).cast("bigint")) + F.when(k < n - 1, 32).otherwise(0) + 63
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.chr(code(k))), "")


def encoded_lines(points: DataFrame, keys: tuple[str, ...], digits: int = 5) -> DataFrame:
    """keys, encoded of lines given by place, x (longitude) and y (latitude).

    Each point's difference from the one before is written by itself, in the JVM;
    the parts are put together in order.
    """
    order = Window.partitionBy(*keys).orderBy("place")
    whole = lambda c: F.floor(F.col(c) * 10**digits + 0.5).cast("bigint")
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(order), F.lit(0).cast("bigint"))
    rows = points.select(*keys, "place", whole("y").alias("lat"), whole("x").alias("lon")).withColumns({"dlat": step("lat"), "dlon": step("lon")})
    parts = rows.select(*keys, "place", F.concat(_groups(F.col("dlat")), _groups(F.col("dlon"))).alias("part"))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "part"))), lambda p: p["part"]), "").alias("encoded"))


def spaced(candidates: DataFrame, keys: tuple[str, ...], spacing: float, most: int) -> DataFrame:
    """Greedy choice by score: at most ``most`` a group, each ``spacing`` from the ones before.

    Candidates a group are few, the extrema or labels of one frame. Ties go by y, then x.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen: list[int] = []
        ordered = pdf.sort_values(["score", "y", "x"], ascending=[False, True, True]).reset_index(drop=True)
        for k, (x, y) in enumerate(ordered[["x", "y"]].itertuples(index=False)):
            if len(chosen) == most:
                break
            if all((x - ordered["x"][c]) ** 2 + (y - ordered["y"][c]) ** 2 >= spacing**2 for c in chosen):
                chosen.append(k)
        return ordered.loc[chosen]

    return candidates.groupBy(*keys).applyInPandas(one, candidates.schema)
