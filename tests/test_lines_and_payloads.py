import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from nimbostrat.operators import polyline
from nimbostrat.plans.catalog import catalog, products
from nimbostrat.sources.payload import decode_frames, encode_frames, merge_frames, pack, unpack
from nimbostrat.streaming.run_max import running_maxima

coordinate = st.floats(-80, 80).map(lambda x: round(x, 5))


@given(st.lists(st.tuples(coordinate, coordinate), max_size=20))
def test_polylines_round_trip(points):
    assert np.allclose(polyline.decode_polyline(polyline.encode_polyline(points)) or np.zeros((0, 2)), points or np.zeros((0, 2)), atol=1.1e-5)


def test_a_known_polyline():
    assert polyline.encode_polyline([(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]) == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"


def test_stitching_uses_every_segment_once():
    square = [((0, 0), (1, 0)), ((1, 1), (1, 0)), ((0, 1), (1, 1)), ((0, 0), (0, 1)), ((5, 5), (6, 6))]
    lines = polyline.stitch(square)
    assert sorted(len(line) for line in lines) == [2, 5] and max(lines, key=len)[0] == max(lines, key=len)[-1]


def test_thinning_and_smoothing():
    points = np.array([(0, 0), (1, 0.01), (2, 0), (3, 2), (4, 0)], float)
    assert polyline.thin(points, 0.1).tolist() == [[0, 0], [2, 0], [3, 2], [4, 0]]
    smooth = polyline.cut_corners(points)
    assert smooth[0].tolist() == [0, 0] and smooth[-1].tolist() == [4, 0] and len(smooth) == 8


def test_lengths_and_areas(spark):
    rows = [(1, k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (3, 0), (3, 4), (0, 0)])] + [(2, 0, 1.0, 1.0)]
    out = {r["line"]: r for r in polyline.lengths_and_areas(spark.createDataFrame(rows, "line int, place int, x double, y double"), ("line",)).collect()}
    assert (out[1]["length"], out[1]["area"], out[2]["length"], out[2]["area"]) == (12, 6, 0, 0)


def test_spacing_is_greedy_by_score(spark):
    marks = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (1, 1.0, 0.0, 9.0), (1, 9.0, 0.0, 1.0), (1, 20.0, 0.0, 0.5)], "f int, x double, y double, score double")
    assert sorted(r["x"] for r in polyline.spaced(marks, ("f",), 5.0, 2).collect()) == [1.0, 9.0]


@pytest.mark.parametrize("binary", [True, False])
def test_payloads(spark, binary):
    cells = spark.createDataFrame([(1, "t", 0.1, 0, 0, 1.26), (1, "t", 0.1, 1, 1, None), (1, "u", 0.1, 0, 0, None), (2, "t", 0.1, 0, 1, -2.0)], "frame int, variable string, scale double, row int, col int, value double")
    packed = encode_frames(cells, 2, 2, ("frame",), binary)
    out = {(r["frame"], r["variable"], r["row"], r["col"]): r["value"] for r in decode_frames(packed, ("frame",)).collect()}
    assert len(out) == 8 and out[1, "t", 0, 0] == pytest.approx(1.3) and out[1, "t", 1, 1] is None and out[2, "t", 0, 1] == pytest.approx(-2)
    merged = merge_frames(decode_frames(packed, ("frame",)), decode_frames(packed.where("frame = 2"), ("frame",)), ("frame",))
    assert merged.count() == 8


def test_payload_header():
    rows, cols, planes = unpack(pack(3, 4, {"a": (0.5, np.arange(12))}))
    assert (rows, cols) == (3, 4) and planes["a"][:3] == (0.5, 0, -32768) and planes["a"][3].tolist() == list(range(12))


RECORDS = "hour int, ordinal int, record string, param string, level string, forecast string"


def test_catalog(spark):
    assert catalog(spark).select("entry").distinct().count() == 79
    records = spark.createDataFrame([(1, 0, "1", "TMP", "2 m above ground", ""), (1, 1, "2", "RH", "2 m above ground", ""), (1, 2, "3", "REFC", "entire atmosphere", "")], RECORDS)
    have = {r["entry"] for r in products(records, spark, "gfs").where("available").collect()}
    assert {"temperature", "humidity2m", "surfaceBasedLclHeight", "reflectivityComposite"} <= have and not {"wind", "dewpoint2m", "precip", "dcape"} & have


def test_products_need_profiles_and_liquid(spark):
    """Snow needs its liquid, an hour above 0 and every level of its profile; dcape one level of each variable."""
    levels = [x for x in range(1000, 499, -25)]
    base = [("TMP", "2 m above ground", ""), ("DPT", "2 m above ground", ""), ("WEASD", "surface", "0-6 hour acc fcst")]
    profile = [(v, f"{x} mb", "") for v in ("TMP", "HGT") for x in levels]

    def have(hour, rows, model="gfs"):
        table = spark.createDataFrame([(hour, k, str(k), *r) for k, r in enumerate(rows)], RECORDS)
        return {r["entry"] for r in products(table, spark, model).where("available").collect()}

    whole = have(6, base + profile)
    assert {"snow10to1", "snowKuchera"} <= whole and not {"snowCobb", "dcape", "framFlatIce", "snowWesternLinear"} & whole
    assert "snowKuchera" not in have(6, base + profile[1:]) and "snow10to1" in have(6, base)
    assert not {"snow10to1", "snowKuchera"} & (have(0, base + profile) | have(6, base[:2] + profile))
    assert "dcape" in have(6, base + [("TMP", "850 mb", ""), ("HGT", "700 mb", ""), ("RH", "300 mb", "")])
    masks = [("APCP", "surface", "0-6 hour acc fcst"), *[(m, "surface", "6 hour fcst") for m in ("CSNOW", "CRAIN", "CFRZR", "CICEP")]]
    assert "snow10to1" in have(6, masks) and "freezingRainLiquidTotal" in have(6, masks) and "snow10to1" not in have(6, masks[:-1])
    assert "freezingRainLiquidTotal" in have(6, [("FRZR", "surface", "3-6 hour acc fcst")]) and "freezingRainLiquidTotal" not in have(7, [("FRZR", "surface", "3-6 hour acc fcst")])
    assert "precipRateAndType" not in have(6, [("PRATE", "surface", ""), *masks], "nam") and "precipRateAndType" in have(6, [("PRATE", "surface", ""), *masks], "hrrr")


def test_streamed_run_max(spark, tmp_path):
    source, out = str(tmp_path / "in"), []
    schema = "cell bigint, value double"
    spark.createDataFrame([(1, 5.0), (2, None), (1, 2.0)], schema).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([(1, 7.0), (2, -3.0)], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = running_maxima(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda df, k: out.extend(df.collect())).start()
    query.awaitTermination(120)
    last = {r["cell"]: (r["hours"], r["run_max"]) for r in sorted(out, key=lambda r: r["hours"])}
    assert last == {1: (3, 7.0), 2: (2, 0.0)}


def test_lines_are_encoded_as_by_the_plain_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(k, i, float(rng.uniform(-180, 180)), float(rng.uniform(-80, 80))) for k in range(3) for i in range(12)]
    got = {r["line"]: r["encoded"] for r in polyline.encoded_lines(spark.createDataFrame(rows, "line int, place int, x double, y double"), ("line",)).collect()}
    assert got == {k: polyline.encode_polyline([(y, x) for line, _, x, y in rows if line == k]) for k in range(3)}
