"""Stencils by tiles against whole rows and columns, and labels against a plain greedy search."""

import math
import random

import pytest
from pyspark.sql import functions as F

from nimbostrat.operators import labels, stencil, tiles

GRID = "frame int, row int, col int, v double"


def cells(spark, rows, cols, seed, frames=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(f, r, c, None if rng.random() < 0.08 else rng.uniform(-2, 5)) for f in range(frames) for r in range(rows) for c in range(cols)], GRID)


def table(df, *columns):
    return {(r["frame"], r["row"], r["col"]): tuple(r[c] for c in columns) for r in df.collect()}


CASES = {
    "two passes": (4, lambda g, k: stencil.smooth(g, 2, keys=k), "smoothed"),
    "blur": (2, lambda g, k: stencil.gaussian_blur(g, 1.0, 2, keys=k), "blurred"),
    "extrema": (2, lambda g, k: stencil.extrema(g, 2, keys=k), "kind"),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize(("rows", "cols", "side"), [(23, 17, 5), (1, 9, 4), (12, 12, 12), (9, 30, 64)])
def test_tiles_equal_whole_windows(spark, case, rows, cols, side):
    halo, apply, name = CASES[case]
    grid = cells(spark, rows, cols, rows, frames=2)
    want = table(apply(grid, ("frame",)), name)
    got_rows = tiles.over_tiles(grid, halo, apply, ("frame",), side)
    assert set(got_rows.columns) == set(apply(grid, ("frame",)).columns)
    got = table(got_rows, name)
    assert got.keys() == want.keys() and got_rows.count() == len(want)
    for key, (value,) in want.items():
        assert got[key][0] == (pytest.approx(value, rel=1e-12) if isinstance(value, float) else value)


def test_no_window_is_longer_than_a_tile_with_its_margins(spark):
    """A frame of one long row: the largest group of a window is bounded by side and halo."""
    grid = spark.range(5000).select(F.lit(0).alias("frame"), F.lit(0).alias("row"), F.col("id").cast("int").alias("col"), F.lit(1.0).alias("v"))
    groups = tiles.tiled(grid, 3, 64).groupBy("frame", "tile_row", "tile_col", "row").count()
    assert groups.agg(F.max("count")).first()[0] <= 64 + 2 * 3
    assert tiles.tiled(grid, 3, 64).where("own").count() == 5000


POINTS = "frame int, line int, value int, place int, x double, y double"


def drawn(seed, lines=60, frames=3):
    rng, rows = random.Random(seed), []
    for k in range(lines):
        x, y = rng.uniform(0, 20), rng.uniform(0, 20)
        for place in range(rng.randrange(1, 7)):
            rows.append((k % frames, k, k % 5, place, x, y))
            if rng.random() < 0.9:
                x, y = x + rng.uniform(-3, 3), y + rng.uniform(-3, 3)
    return rows


def plain(rows, spacing, bounds, taken, reach):
    """Every place of every line compared with every label."""
    out = []
    for frame in sorted({r[0] for r in rows}):
        placed = [(t[2], t[3]) for t in taken if t[0] == frame]
        for line in sorted({r[1] for r in rows if r[0] == frame}):
            points = [(r[4], r[5]) for r in sorted(r for r in rows if r[1] == line)]
            value = next(r[2] for r in rows if r[1] == line)
            if any(t[0] == frame and t[1] == value and math.hypot(t[2] - x, t[3] - y) <= reach for t in taken for x, y in points):
                continue
            sizes = [math.dist(a, b) for a, b in zip(points, points[1:], strict=False)]
            for share in labels.SHARES:
                at, upto = share * sum(sizes), 0.0
                spot = None
                for (a, b), size in zip(zip(points, points[1:], strict=False), sizes, strict=False):
                    if size and upto < at <= upto + size:
                        s = (at - upto) / size
                        spot = (a[0] + (b[0] - a[0]) * s, a[1] + (b[1] - a[1]) * s)
                    upto += size
                if spot and bounds[0] <= spot[0] <= bounds[2] and bounds[1] <= spot[1] <= bounds[3] and all(math.dist(spot, p) >= spacing for p in placed):
                    placed.append(spot)
                    out.append((frame, line, value, *spot))
                    break
    return out


@pytest.mark.parametrize("labelled", [False, True])
def test_labels_match_a_plain_search(spark, labelled):
    rows, bounds = drawn(4), (1.0, 1.0, 19.0, 19.0)
    taken = [(f, v, 4.0 * v + f, 10.0 + f) for f in range(3) for v in range(5)] if labelled else []
    given = spark.createDataFrame(taken, "frame int, value int, x double, y double") if labelled else None
    got = sorted((r["frame"], r["line"], r["value"], r["x"], r["y"]) for r in labels.line_labels(spark.createDataFrame(rows, POINTS), 2.0, bounds, given).collect())
    want = sorted(plain(rows, 2.0, bounds, taken, 1.0))
    assert len(want) > 20 and [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[3:] == pytest.approx(w[3:], abs=1e-9)


def test_angles_are_readable(spark):
    rows = [(0, 0, 1, 0, 5.0, 5.0), (0, 0, 1, 1, 2.0, 5.0), (0, 1, 1, 0, 9.0, 9.0), (0, 1, 1, 1, 9.0, 12.0), (0, 2, 1, 0, 1.0, 1.0)]
    got = {r["line"]: r["angle"] for r in labels.line_labels(spark.createDataFrame(rows, POINTS), 1.0, (0.0, 0.0, 20.0, 20.0)).collect()}
    assert got == {0: pytest.approx(0.0), 1: pytest.approx(90.0)}  # a line of one point has no label


def test_frames_are_not_held_whole(spark):
    """A frame's candidates pass in batches; only its labels are held."""
    import pyarrow as pa

    given = pa.RecordBatch.from_pydict({"frame": [0] * 7, "line": [None, 1, 1, 2, 2, 3, 3], "turn": [-1, 0, 1, 0, 1, 0, 1], "x": [0.0, 0.5, 3.0, 3.5, 9.0, 9.5, 0.1], "y": [0.0] * 7})
    out = labels.place_labels(iter([given.slice(k, 1) for k in range(7)]), 2.0, ("frame",))
    assert [(b["line"][0].as_py(), b["x"][0].as_py()) for b in out] == [(1, 3.0), (2, 9.0)]
    plan = labels.line_labels(spark.createDataFrame(drawn(4), POINTS), 2.0, (1.0, 1.0, 19.0, 19.0))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
