import pytest

from nimbostrat.functions.mercator import Bounds
from nimbostrat.operators import contour, intervals, resample, stencil, timeaxis
from nimbostrat.sources.inventory import byte_ranges, dotted, parse_lines, window_bounds
from pyspark.sql import functions as F


def test_index_lines(spark):
    lines = ["1:0:d=2024010100:TMP:2 m above ground:1 hour fcst:", "2.1:100:d=2024010100:UGRD:10 m:anl:", "2.2:100:d=2024010100:VGRD:10 m:anl:", "3:400:d=2024010100:APCP:surface:0-1 day acc fcst:", "bad line", "4:x:d=1:TMP:a:b:"]
    table = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "hour int, ordinal int, line string")
    rows = parse_lines(table)
    ranges = {r["record"]: (r["first_byte"], r["last_byte"]) for r in byte_ranges(rows, length=F.lit(900)).collect()}
    assert ranges == {"1": (0, 99), "2.1": (100, 399), "2.2": (100, 399), "3": (400, 899)}
    assert {r["record"]: r["last_byte"] for r in byte_ranges(rows).collect()}["3"] is None
    start, end = window_bounds(F.col("forecast"))
    assert rows.where("record = '3'").select(start.alias("a"), end.alias("b")).first() == (0, 24)
    order = [r["record"] for r in rows.orderBy(dotted(F.col("record"))).collect()]
    assert order == ["1", "2.1", "2.2", "3"]


def test_interval_plans(spark):
    rows = [("m", 0, 0, 1), ("m", 0, 1, 2), ("m", 1, 0, 3), ("m", 0, 2, 3), ("m", 1, 3, 6), ("g", 0, 0, 1), ("g", 0, 2, 6)]
    spans = spark.createDataFrame(rows, "model string, kind_rank int, start_hour bigint, end_hour bigint")
    tiles = [(r["start_hour"], r["end_hour"]) for r in intervals.longest_tiling(spans, 0, 6).orderBy("step").collect()]
    assert tiles == [(0, 3), (3, 6)]
    path = [(r["start_hour"], r["end_hour"]) for r in intervals.ranked_path(spans, 0, 6).orderBy("step").collect()]
    assert path == [(0, 1), (1, 2), (2, 3), (3, 6)]
    targets = spark.createDataFrame([("m", 3), ("m", 6)], "model string, hour bigint")
    terms = intervals.window_terms(spans.select("model", "start_hour", "end_hour"), 3, targets).collect()
    assert sorted((r["hour"], r["start_hour"], r["end_hour"], r["weight"]) for r in terms) == [(3, 0, 3, 1.0), (6, 3, 6, 1.0)]


def grid(spark, rows):
    cells = [(r, c, None if v is None else float(v)) for r, line in enumerate(rows) for c, v in enumerate(line)]
    return spark.createDataFrame(cells, "row int, col int, v double")


def test_smoothing_keeps_holes_and_constants(spark):
    flat = grid(spark, [[2.0] * 6, [2.0, None, 2.0, 2.0, 2.0, 2.0]] + [[2.0] * 6] * 3)
    out = {(r["row"], r["col"]): r["smoothed"] for r in stencil.smooth(flat, passes=3).collect()}
    assert out.pop((1, 1)) is None and all(v == pytest.approx(2.0) for v in out.values())


def test_frontogenesis_needs_deformation(spark):
    bounds = Bounds(45.0, 40.0, -105.0, -95.0)
    rows = lambda u: [(r, c, 280.0 + c, u(c), 0.0) for r in range(5) for c in range(5)]
    schema = "row int, col int, t double, u double, v double"
    middle = lambda u: stencil.frontogenesis(spark.createDataFrame(rows(u), schema), bounds, 5, 5, 850.0).where("row = 2 AND col = 2").first()["frontogenesis"]
    assert middle(lambda c: 10.0) == pytest.approx(0) and middle(lambda c: 20.0 - c) > 0


def test_contours_close_around_a_peak(spark):
    peak = grid(spark, [[0, 0, 0], [0, 1, 0], [0, 0, 0.0]])
    lines = contour.segments(peak, [0.5]).collect()
    assert len(lines) == 4 and all(abs(r["x1"] - 1) + abs(r["y1"] - 1) == 0.5 for r in lines)
    hole = grid(spark, [[0, 0, 0], [0, 1, 0], [0, 0, None]])
    assert contour.segments(hole, [0.5]).count() == 3


def test_sampling_rules(spark):
    cells = grid(spark, [[0.0, 2.0], [None, 4.0]])
    points = spark.createDataFrame([(1, 0.5, 0.0), (2, 0.5, 0.5), (3, 1.5, 0.0)], "point int, fx double, fy double")
    loose = {r["point"]: r["value"] for r in resample.sample(points, cells, 2, 2).collect()}
    strict = {r["point"]: r["value"] for r in resample.sample(points, cells, 2, 2, strict=True).collect()}
    assert loose == {1: 1.0, 2: 2.0} and strict == {1: 1.0, 2: None}


def test_stats_by_nearest_rank(spark):
    cells = grid(spark, [[0, 100, 500, 2500, 3000, None]])
    r = resample.nearest_rank_stats(cells, top=2500.0).first()
    assert (r["n"], r["min"], r["p50"], r["p90"], r["p99"], r["max"], r["clamp_percent"]) == (5, 0, 500, 3000, 3000, 3000, 40)


def test_axes(spark):
    frames = spark.createDataFrame([("a", 0), ("a", 3), ("b", 6)], "model string, hour bigint")
    hours = lambda df: sorted(r["hour"] for r in df.collect())
    assert hours(timeaxis.axis_intersection(frames, ["a", "b"])) == [0, 3] and hours(timeaxis.axis_union(frames, ["a", "b"])) == [0, 3, 6]
    targets = spark.createDataFrame([(1, 1), (2, 50)], "target_id int, hour bigint")
    near = timeaxis.nearest_frame(targets, frames).collect()
    # however far: no target is left out
    assert sorted((r["target_id"], r["model"], r["frame_hour"], r["delta_minutes"]) for r in near) == [(1, "a", 0, 60), (1, "b", 6, 300), (2, "a", 3, 2820), (2, "b", 6, 2640)]
    assert [r["next_hour"] for r in timeaxis.next_with_wrap(frames).where("model = 'a'").orderBy("hour").collect()] == [3, 0]
