"""Library queries on tables larger than the smallest ones."""

import math
import os

import duckdb
import numpy as np
import pytest

from nimbostrat.functions.mercator import CONUS
from nimbostrat.operators.resample import resample_points
from nimbostrat.plans.queries import ORACLE_SQL, QUERIES

ROWS, COLS = 1203, 8


@pytest.fixture(scope="module")
def field():
    return np.random.default_rng(3).normal(0, 0.1, (ROWS, COLS)).astype(np.float32).astype(float)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, field):
    path = str(tmp_path_factory.mktemp("large"))
    spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(field)], "vec_id bigint, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(k,) for k in range(1000)], "event_id bigint").write.parquet(f"{path}/events.parquet")
    return path


@pytest.fixture(scope="module")
def run(spark, folder):
    def rows(name, *keys):
        got = QUERIES[name](spark, folder).collect()
        out = {tuple(r[k] for k in keys): r for r in got}
        assert len(out) == len(got)
        return out

    return rows


def y(latitude):
    return math.log(math.tan(math.pi / 4 + math.radians(latitude) / 2))


def latitude(row):
    return math.degrees(2 * math.atan(math.exp(y(CONUS.north) + (y(CONUS.south) - y(CONUS.north)) * row / (ROWS - 1))) - math.pi / 2)


def holed(field):
    r, c = np.indices(field.shape)
    return np.where((r * 31 + c * 17) % 23 == 0, np.nan, field)


def bilinear(field, fx, fy, strict=False):
    x, z = int(fx), int(fy)
    pairs = [(field[min(z + b, ROWS - 1), min(x + a, COLS - 1)], (fx - x if a else 1 - fx + x) * (fy - z if b else 1 - fy + z)) for a in (0, 1) for b in (0, 1)]
    used = [(v, w) for v, w in pairs if w > 0 and not math.isnan(v)]
    if strict and len(used) < sum(w > 0 for _, w in pairs) or not used:
        return None
    return sum(v * w for v, w in used) / (1 if strict else sum(w for _, w in used))


def same(got, expected):
    assert (got is None) == (expected is None)
    assert got is None or got == pytest.approx(expected, abs=2e-5)


def test_stencils_cover_every_row(run, field):
    relative = run("relative_vorticity", "row", "col")
    assert len(relative) == ROWS * COLS
    for r in (0, 499, 500, ROWS - 1):
        same(relative[r, 3]["relative"], (field[r, 3] * 1e-4 - 2 * 7.2921e-5 * math.sin(math.radians(latitude(r)))) * 1e5)
    fronts = run("frontogenesis", "row", "col")
    assert len(fronts) == ROWS * COLS
    assert all((v["frontogenesis"] is not None) == (0 < r < ROWS - 1 and 0 < c < COLS - 1) for (r, c), v in fronts.items())


def test_resampling_covers_every_row(run, field):
    rows, cols = 482, 5
    for name in ("resample_strict", "resample_renormalised"):
        got = run(name, "point")
        assert len(got) == rows * cols
        for point in range(0, rows * cols, 7):
            fx, fy = point % cols * ((COLS - 1) / (cols - 1)), point // cols * ((ROWS - 1) / (rows - 1))
            same(got[point,]["value"], bilinear(holed(field), fx, fy, name == "resample_strict"))


def test_resampled_edges_stay_on_the_raster(spark):
    assert resample_points(spark.range(1), 2000, 64, 800, 40).where("fy > 1999 OR fx > 63").count() == 0


def test_remapping_covers_every_row(run, field):
    source = [min(max((latitude(r) - CONUS.south) / (CONUS.north - CONUS.south) * (ROWS - 1), 0.0), ROWS - 1.0) for r in range(ROWS)]
    near, linear = run("mercator_remap_nearest", "row", "col"), run("mercator_remap_bilinear", "row", "col")
    assert len(near) == ROWS * COLS == len(linear)
    for r in (0, 250, 700, ROWS - 1):
        for c in range(COLS):
            v = holed(field)[int(source[r] + 0.5), c]
            same(near[r, c]["value"], None if math.isnan(v) else v)
            same(linear[r, c]["value"], bilinear(holed(field), c, source[r]))


def test_points_fall_on_the_whole_raster(run, field):
    got, n = run("hover_point_sample", "point"), 0
    for e in range(1000):
        lat, lon = CONUS.south - 2 + e * 37 % 1000 * 0.036, CONUS.west - 2 + e * 91 % 1000 * 0.07
        fx, fy = (lon - CONUS.west) / (CONUS.east - CONUS.west) * (COLS - 1), (y(CONUS.north) - y(lat)) / (y(CONUS.north) - y(CONUS.south)) * (ROWS - 1)
        if 0.001 <= fx <= COLS - 1.001 and 0.001 <= fy <= ROWS - 1.001:
            n += 1
            assert got[e,]["value"] == pytest.approx(bilinear(holed(field), fx, fy), abs=1e-4)
    assert 0 <= len(got) - n < 5


TABLES = "/root/testdata/sf0.01"  # 100 suppliers


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")
@pytest.mark.parametrize("name", ["idx_parse_windows", "idx_byte_ranges", "record_first_match", "record_dotted_order", "catalog_availability", "missing_required_anti"])
def test_inventory_covers_every_supplier(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{TABLES}/lineitem.parquet')")
    plain = lambda rows: sorted(tuple(str(None if x != x else x) for x in row) for row in rows)
    got = QUERIES[name](spark, TABLES)
    columns = [f'"{c}"' for c in got.columns]
    assert plain(got.collect()) == plain(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall())
    assert got.select("hour").distinct().count() > 24


def test_payloads_give_back_the_tables_cells_alone(spark, tmp_path):
    # a last frame of fewer rows, a frame without a known value, a gap, vectors of other lengths, one id twice
    vectors = [(k, [0.001 * k] * (4 + k % 3)) for k in [*range(53), 120]] + [(200, [None] * 5), (7, [1.5] * 3)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    plain = lambda rows: sorted(tuple(str(x) for x in row) for row in rows)
    got = QUERIES["payload_round_trip"](spark, str(tmp_path)).select("frame", "variable", "row", "col", "value").collect()
    assert plain(got) == plain(con.execute(f"SELECT frame, variable, row, col, value FROM ({ORACLE_SQL['payload_round_trip']})").fetchall())
