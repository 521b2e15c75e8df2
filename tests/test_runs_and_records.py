"""Runs, records and rendering on small cases."""

import pytest
from pyspark.sql import functions as F

from nimbostrat.operators import accumulate, frames, render, runs, snow, timeaxis
from nimbostrat.sources import inventory, planes


def test_run_times(spark):
    row = spark.createDataFrame([("20240228", 18, [0, 30]), ("20231231", 0, [])], "day string, cycle int, hours array<int>")
    out = runs.metadata(row).collect()
    assert (out[0]["run_id"], out[0]["reference_time"], out[0]["valid_times"]) == ("20240228-1800Z", "2024-02-28T18:00:00Z", ["2024-02-28T18:00:00Z", "2024-03-01T00:00:00Z"])
    assert out[1]["valid_times"] == []


def test_hours_of_a_request(spark):
    rows = spark.createDataFrame([("a", "3, 0,2.5,-1,x,3"), ("b", "x,-2"), ("c", None)], "request string, hours string")
    assert sorted(map(tuple, runs.parse_hours(rows, "hours").collect())) == [("a", 0), ("a", 3)]
    models = spark.createDataFrame([("nam", 6, 3)], runs.MODEL_SCHEMA)
    assert [r["hour"] for r in runs.full_hours(models).collect()] == [0, 3, 6]
    fine, beyond = (spark.createDataFrame([("nam", h)], "model string, hour bigint") for h in (6, 7))
    assert runs.check_hours(fine, models).first()["hour"] == 6
    with pytest.raises(Exception, match="nam has no forecast hour 7"):
        runs.check_hours(beyond, models).collect()
    names = spark.createDataFrame([(" HRRR",)], "name string")
    assert names.select(runs.known_model(F.col("name"))).first()[0] == "hrrr"
    with pytest.raises(Exception, match="unknown model: x"):
        spark.createDataFrame([("x",)], "name string").select(runs.known_model(F.col("name"))).collect()


def test_nearest_frames_have_no_reach(spark):
    targets = spark.createDataFrame([(1, 100), (2, 5), (3, -9)], "target_id int, hour bigint")
    held = spark.createDataFrame([("a", 4), ("a", 6), ("b", 90)], "model string, hour bigint")
    got = {(r["target_id"], r["model"]): (r["frame_hour"], r["delta_minutes"]) for r in timeaxis.nearest_frame(targets, held).collect()}
    assert got == {(1, "a"): (6, 5640), (2, "a"): (4, 60), (3, "a"): (4, 780), (1, "b"): (90, 600), (2, "b"): (90, 5100), (3, "b"): (90, 5940)}
    assert timeaxis.nearest_frame(targets, held.limit(0)).count() == 0


RECORD = "hour int, ordinal int, record string, offset int, param string, level string, forecast string"


def test_records(spark):
    rows = spark.createDataFrame(
        [
            (6, 1, "1", 0, "APCP", "surface", "0-6 hour acc fcst"), (6, 2, "2", 5, "APCP", "surface", "3-6 hour acc fcst"), (6, 3, "3", 9, "FRZR", "surface", "0-6 hour acc fcst"),
            (6, 4, "4", 11, "FRZR", "surface", "3-6 hour acc fcst"), *[(6, 5 + k, str(5 + k), 20 + k, p, "surface", "3-6 hour ave fcst") for k, p in enumerate(inventory.PHASE_MASKS)],
        ],
        RECORD,
    )
    windows = inventory.with_windows(rows)
    assert [tuple(r) for r in inventory.exact_masks(rows).collect()] == [(6, 3, 6)]
    assert sorted(tuple(r) for r in inventory.masked_candidates(windows).collect()) == [(6, 0, 6, False), (6, 3, 6, True)]
    assert inventory.masked_candidates(windows.where("param <> 'CICEP'")).count() == 0
    assert inventory.longest_ending(windows, "FRZR").first()["start_hour"] == 0
    left, right = rows.alias("l"), rows.alias("r")
    assert left.join(right, inventory.same_record("l", "r")).count() == rows.count()
    doubled = inventory.unique_records(rows.unionByName(rows.withColumn("ordinal", F.col("ordinal") + 100)))
    assert sorted(r["ordinal"] for r in doubled.collect()) == list(range(1, 9))
    assert inventory.profile_complete(rows, ["TMP"], [500], True).first()["ok"] is False


def test_planes(spark, tmp_path):
    cells = spark.createDataFrame([("a", 0, 0, 1.5), ("a", 1, 1, None), ("a", 1, 0, -2.0), ("a", 0, 1, 1e20)], "k string, row int, col int, v double")
    files = planes.encode_planes(cells, ("k",), 2, 2).select(F.col("k").alias("path"), F.col("body").alias("content"))
    at = files.select("path", F.lit("v").alias("name"), F.lit(0).alias("offset"))
    got = {(r["row"], r["col"]): r["v"] for r in planes.decode_planes(files, at, 2, 2).collect()}
    assert got == {(0, 0): 1.5, (0, 1): None, (1, 0): -2.0, (1, 1): None}
    with pytest.raises(Exception, match="short raster"):
        planes.decode_planes(files, at.withColumn("offset", F.lit(4)), 2, 2).collect()


def test_sums_go_on_along_their_steps(spark):
    deltas = spark.createDataFrame([("m", 1, 3, 2.0), ("m", 1, 6, 1.0), ("m", 1, 12, 4.0), ("m", 2, 3, None), ("m", 2, 6, 5.0)], "model string, cell int, hour bigint, value double")
    steps = spark.createDataFrame([("m", 3, 0), ("m", 6, 3), ("m", 12, 9)], "model string, hour bigint, start_hour bigint")
    got = {(r["cell"], r["hour"]): r["total"] for r in accumulate.delta_accumulation(deltas, steps).collect()}
    assert got == {(1, 3): 2.0, (1, 6): 3.0, (1, 12): None, (2, 3): None, (2, 6): None}


def test_ice_segments(spark):
    chunks = spark.createDataFrame([("m", 0, 6), ("m", 6, 9)], "model string, start_hour bigint, end_hour bigint")
    hours = spark.createDataFrame([("m", 1), ("m", 4), ("m", 6)], "model string, hour bigint")
    got = sorted((r["start_hour"], r["hour"], round(r["weight"], 4)) for r in snow.environment_segments(chunks, hours).collect())
    assert got == [(0, 1, 0.1667), (0, 4, 0.5), (0, 6, 0.3333), (6, 9, 1.0)]


def test_levels_and_spacing(spark):
    row = spark.createDataFrame([(-7.0, 25.0, 6.0), (3.0, 1.0, 2.0), (0.0, 1.0, -1.0)], "low double, high double, step double")
    out = row.select(render.contour_levels(F.col("low"), F.col("high"), F.col("step")).alias("c"), render.stepped_levels(F.col("low"), F.col("high"), F.col("step")).alias("s")).collect()
    assert out[0]["c"] == [-6.0, 0.0, 6.0, 12.0, 18.0, 24.0] and out[0]["s"] == [-7.0, -1.0, 5.0, 11.0, 17.0, 23.0]
    assert out[1]["c"] == out[1]["s"] == out[2]["s"] == []
    assert render.grid_spacing_km(50, 20, -60, -130, 71, 31) == pytest.approx((111 + 111 * 0.8191520442889918) / 2)
    assert render.grid_spacing_km(1, 0, 1, 0, 1, 5) == 25.0 and render.grid_spacing_km(1, 0, 1, 0, 500, 500) == 4.0


def test_keys_of_frames(spark):
    planned = spark.createDataFrame([(7, "b/007")], "hour int, base string")
    layers = spark.createDataFrame([("t", "image"), ("h", "contour"), ("w", "vector"), ("r", "reflectivity")], "layer string, kind string")
    keys = sorted(r["key"] for r in frames.asset_keys(planned, layers, [5, 15]).collect())
    assert keys == ["b/007/h-contours.json", "b/007/h.png", "b/007/r-g15.png", "b/007/r-g5.png", "b/007/t.png", "b/007/w-vectors.json"]


def test_lines_are_split_once_and_records_not_sorted(spark):
    """Parts of a line are made once; first matches are found by hash, before whole records are looked at."""
    from nimbostrat.sources import inventory

    lines = spark.range(9).selectExpr("id % 2 AS hour", "id AS ordinal", "concat_ws(':', id, id, 'd=2024010100', 'CAPE', if(id < 4, 'x', 'surface'), 'anl', '') AS line")
    rows = inventory.parse_lines(lines)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    wanted = spark.createDataFrame([("a", "CAPE", None, None), ("b", "CAPE", "x", None)], "selector string, param string, level string, level_regex string")
    found = inventory.first_match(rows, wanted)
    assert "ShuffledHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["hour"], r["selector"], r["ordinal"]) for r in found.collect()) == [(0, "a", 4), (0, "b", 0), (1, "a", 5), (1, "b", 1)]
    missing = inventory.first_match(rows.withColumn("ordinal", F.expr("nullif(ordinal, 6)")).withColumn("hour", F.expr("nullif(hour, 1)")), wanted)
    assert sorted((str(r["hour"]), r["selector"], str(r["record"])) for r in missing.collect()) == [("0", "a", "6"), ("0", "b", "0"), ("None", "a", "5"), ("None", "b", "1")]


def test_ranges_by_a_growing_frame(spark):
    """Next offsets come from a frame that grows, so a file's records are gone through once."""
    rows = spark.createDataFrame([(0, 5), (0, 5), (0, 9), (0, None), (1, 3)], "hour int, offset bigint")
    out = inventory.byte_ranges(rows)
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted((r["hour"], str(r["first_byte"]), r["last_byte"]) for r in out.collect() if r["hour"] == 0) == [(0, "5", 8), (0, "5", 8), (0, "9", None), (0, "None", 4)]
