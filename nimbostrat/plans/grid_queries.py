"""Grid queries: stencils, resampling, contours, quantisation and colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nimbostrat.functions import units
from nimbostrat.functions.mercator import CONUS
from nimbostrat.operators import contour, labels, resample, stencil, tiles
from nimbostrat.plans.registry import ORACLE_SQL, query
from nimbostrat.sources.proxies import GRID_SQL, HOLED_SQL, grid, holed_grid, table

# The raster of the SQL is the whole table, too.
LAST_ROW, LAST_COL = "CAST((SELECT max(vec_id) FROM embeddings) AS DOUBLE)", "CAST((SELECT max(len(embedding)) - 1 FROM embeddings) AS DOUBLE)"


def raster(spark: SparkSession, sf_dir: str, holes: bool = False) -> tuple[DataFrame, int, int]:
    """The whole grid as one raster, with its rows and columns."""
    size = table(spark, sf_dir, "embeddings").agg(F.max("vec_id").alias("row"), F.max(F.size("embedding")).alias("cols")).first()
    rows, cols = (0, 0) if size["row"] is None else (size["row"] + 1, size["cols"])
    return holed_grid(spark, sf_dir) if holes else grid(spark, sf_dir), rows, cols


def thinned(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    """Two rows for five and five columns for eight, over the whole raster."""
    cells, rows, cols = raster(spark, sf_dir, True)
    points = resample.resample_points(cells, rows, cols, -(-rows * 2 // 5), -(-cols * 5 // 8))
    return resample.sample(points, cells, rows, cols, strict=strict).select("point", F.round("value", 6).alias("value"))


CROP_SQL = HOLED_SQL + ", crop AS (SELECT * FROM grid), hcrop AS (SELECT * FROM holed)"


def _axis(source: str, out: str, part: str, order: str, weights: tuple, value: str = "v") -> str:
    """SQL of one smoothing axis over the present taps."""
    r = len(weights) // 2
    tap = lambda k: value if k == r else f"{'lag' if k < r else 'lead'}({value}, {abs(k - r)}) OVER w"
    top = " + ".join(f"coalesce({tap(k)} * {w!r}, 0)" for k, w in enumerate(weights))
    low = " + ".join(f"CASE WHEN {tap(k)} IS NOT NULL THEN {w!r} ELSE 0 END" for k, w in enumerate(weights))
    return f"{out} AS (SELECT *, ({top}) / nullif({low}, 0) AS x_{out} FROM {source} WINDOW w AS (PARTITION BY {part} ORDER BY {order}))"


SMOOTH_SQL = (
    f"WITH {HOLED_SQL}, " + _axis("holed", "h", "row", "col", stencil.BINOMIAL) + ", g AS (SELECT row, col, v, CASE WHEN v IS NOT NULL THEN x_h END AS y FROM h), "
    + _axis("g", "s", "col", "row", stencil.BINOMIAL, "y") + " SELECT row, col, round(CASE WHEN v IS NOT NULL THEN greatest(0, x_s) END, 6) AS smoothed FROM s"
)


@query("smooth5_renormalised", SMOOTH_SQL)
def smooth5_renormalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.smooth(holed_grid(spark, sf_dir)).select("row", "col", F.round("smoothed", 6).alias("smoothed"))


POSITIVE_SQL = (
    f"WITH {HOLED_SQL}, pos AS (SELECT row, col, greatest(0, v) AS v FROM (SELECT * FROM holed WHERE v IS NOT NULL) UNION ALL SELECT row, col, NULL FROM holed WHERE v IS NULL), " + _axis("pos", "h", "row", "col", stencil.BINOMIAL)
    + ", g AS (SELECT row, col, v, CASE WHEN v IS NOT NULL THEN x_h END AS y FROM h), " + _axis("g", "s", "col", "row", stencil.BINOMIAL, "y") + " SELECT row, col, round(CASE WHEN v IS NOT NULL THEN greatest(0, x_s) END, 6) AS smoothed FROM s"
)


@query("presentation_smoothing", POSITIVE_SQL)
def presentation_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positive part alone, smoothed, as it is shown."""
    return stencil.presentation(holed_grid(spark, sf_dir)).select("row", "col", F.round("smoothed", 6).alias("smoothed"))


WEIGHTS = stencil.gaussian_weights(1.5, 3)
BLUR_SQL = f"WITH {HOLED_SQL}, " + _axis("holed", "h", "row", "col", WEIGHTS) + ", g AS (SELECT row, col, x_h AS y FROM h), " + _axis("g", "s", "col", "row", WEIGHTS, "y") + " SELECT row, col, round(x_s, 6) AS blurred FROM s"


@query("gaussian_blur", BLUR_SQL)
def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.gaussian_blur(holed_grid(spark, sf_dir), 1.5, 3).select("row", "col", F.round("blurred", 6).alias("blurred"))


LAT = f"degrees(2 * atan(exp(ln(tan(pi() / 4 + radians({CONUS.north}) / 2)) + (ln(tan(pi() / 4 + radians({CONUS.south}) / 2)) - ln(tan(pi() / 4 + radians({CONUS.north}) / 2))) * ({{r}}) / {LAST_ROW})) - pi() / 2)"


@query(
    "frontogenesis",
    f"""WITH {CROP_SQL}, c AS (SELECT row, col, (280 + 20 * v) * pow(1000 / 850.0, 0.2854) AS th, 10 + 30 * v AS u, 5 - 40 * v * v AS w FROM crop),
    d AS (SELECT *, 2 * 6371000 * cos(radians({LAT.format(r="row")})) * radians({CONUS.east - CONUS.west}) / {LAST_COL} AS dx,
            6371000 * abs(radians({LAT.format(r="row - 1")}) - radians({LAT.format(r="row + 1")})) AS dy FROM c),
    g AS (SELECT row, col, (lead(th) OVER a - lag(th) OVER a) / dx AS tx, (lead(u) OVER a - lag(u) OVER a) / dx AS ux, (lead(w) OVER a - lag(w) OVER a) / dx AS vx,
            (lag(th) OVER b - lead(th) OVER b) / dy AS ty, (lag(u) OVER b - lead(u) OVER b) / dy AS uy, (lag(w) OVER b - lead(w) OVER b) / dy AS vy
        FROM d WINDOW a AS (PARTITION BY row ORDER BY col), b AS (PARTITION BY col ORDER BY row))
    SELECT row, col, round(CASE WHEN sqrt(tx * tx + ty * ty) >= 1e-12 THEN -0.5 * ((tx * tx - ty * ty) * (ux - vy) + 2 * tx * ty * (vx + uy) + (tx * tx + ty * ty) * (ux + vy)) * 1e5 * 10800 / sqrt(tx * tx + ty * ty) END, 4) AS frontogenesis FROM g""",
)
def frontogenesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    cells, rows, cols = raster(spark, sf_dir)
    cells = cells.select("row", "col", (280 + 20 * v).alias("t"), (10 + 30 * v).alias("u"), (5 - 40 * v * v).alias("v"))
    return stencil.frontogenesis(cells, CONUS, rows, cols, 850.0).select("row", "col", F.round("frontogenesis", 4).alias("frontogenesis"))


@query("relative_vorticity", f"WITH {CROP_SQL} SELECT row, col, round((v * 1e-4 - 2 * 7.2921e-5 * sin(radians({LAT.format(r='row')}))) * 1e5, 6) AS relative FROM crop")
def relative_vorticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, rows, _ = raster(spark, sf_dir)
    return stencil.relative_vorticity(cells.withColumn("v", F.col("v") * 1e-4), CONUS, rows).select("row", "col", F.round("relative", 6).alias("relative"))


@query(
    "pressure_extrema",
    f"""WITH {GRID_SQL}, l AS (SELECT *, count(v) OVER a AS n1, max(v) OVER a AS h1, min(v) OVER a AS l1 FROM grid WINDOW a AS (PARTITION BY row ORDER BY col ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
    f AS (SELECT row, col, v, sum(n1) OVER b AS n, max(h1) OVER b AS hi, min(l1) OVER b AS lo FROM l WINDOW b AS (PARTITION BY col ORDER BY row ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
    k AS (SELECT row, col, round(v, 6) AS v, CASE WHEN v >= hi - 0.03 AND v - lo > 0.04 THEN 'high' WHEN v <= lo + 0.03 AND hi - v > 0.04 THEN 'low' END AS kind FROM f WHERE n = 81)
    SELECT * FROM k WHERE kind IS NOT NULL""",
)
def pressure_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.extrema(grid(spark, sf_dir)).select("row", "col", F.round("v", 6).alias("v"), "kind")


def _resample_sql(strict: bool) -> str:
    value = "CASE WHEN count(v * w) = count(*) THEN sum(v * w) END" if strict else "sum(v * w) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0)"
    return f"""WITH {CROP_SQL}, new AS (SELECT CAST(ceil(({LAST_ROW} + 1) * 2 / 5) AS BIGINT) AS nr, CAST(ceil(({LAST_COL} + 1) * 5 / 8) AS BIGINT) AS nc), p AS (SELECT i AS point, least((i % nc) * ({LAST_COL} / (nc - 1)), {LAST_COL}) AS fx, least((i // nc) * ({LAST_ROW} / (nr - 1)), {LAST_ROW}) AS fy FROM new, range(nr * nc) AS z(i)),
    c AS (SELECT *, least(floor(fx), {LAST_COL}) AS x0, least(floor(fy), {LAST_ROW}) AS y0 FROM p),
    t AS (SELECT point, least(x0 + dx, {LAST_COL}) AS x, least(y0 + dy, {LAST_ROW}) AS y, (CASE dx WHEN 0 THEN 1 - (fx - x0) ELSE fx - x0 END) * (CASE dy WHEN 0 THEN 1 - (fy - y0) ELSE fy - y0 END) AS w
        FROM c, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy)),
    j AS (SELECT point, w, h.v FROM t LEFT JOIN hcrop h ON h.row = t.y AND h.col = t.x WHERE w > 0)
    SELECT point, round({value}, 6) AS value FROM j GROUP BY point"""


@query("resample_strict", _resample_sql(True))
def resample_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thinned(spark, sf_dir, strict=True)


@query("resample_renormalised", _resample_sql(False))
def resample_renormalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thinned(spark, sf_dir, strict=False)


SOURCE_ROW = f"greatest(0.0, least({LAST_ROW}, ({LAT.format(r='r')} - {CONUS.south}) / {CONUS.north - CONUS.south} * {LAST_ROW}))"


@query(
    "mercator_remap_bilinear",
    f"""WITH {CROP_SQL}, t AS (SELECT CAST(r AS INTEGER) AS row, {SOURCE_ROW} AS y FROM (SELECT DISTINCT row AS r FROM grid)),
    u AS (SELECT row, least(floor(y), {LAST_ROW} - 1) AS lo, y FROM t), p AS (SELECT row, lo + k AS source, CASE k WHEN 0 THEN 1 - (y - lo) ELSE y - lo END AS w FROM u, (VALUES (0), (1)) z(k))
    SELECT p.row, h.col, round(sum(h.v * w) / nullif(sum(CASE WHEN h.v IS NOT NULL THEN w END), 0), 5) AS value FROM p JOIN hcrop h ON h.row = p.source WHERE w > 0 GROUP BY 1, 2""",
)
def mercator_remap_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, rows, _ = raster(spark, sf_dir, True)
    return resample.mercator_remap(cells, rows, CONUS).select("row", "col", F.round("value", 5).alias("value"))


@query(
    "mercator_remap_nearest",
    f"""WITH {CROP_SQL}, t AS (SELECT CAST(r AS INTEGER) AS row, floor({SOURCE_ROW} + 0.5) AS source FROM (SELECT DISTINCT row AS r FROM grid))
    SELECT t.row, h.col, round(h.v, 6) AS value FROM t JOIN hcrop h ON h.row = t.source""",
)
def mercator_remap_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, rows, _ = raster(spark, sf_dir, True)
    return resample.mercator_remap(cells, rows, CONUS, nearest=True).select("row", "col", F.round("value", 6).alias("value"))


@query(
    "hover_point_sample",
    f"""WITH {CROP_SQL}, e AS (SELECT event_id AS point, {CONUS.south} - 2 + (event_id * 37 % 1000) * 0.036 AS lat, {CONUS.west} - 2 + (event_id * 91 % 1000) * 0.07 AS lon FROM events),
    p AS (SELECT point, (lon - ({CONUS.west})) / {CONUS.east - CONUS.west} * {LAST_COL} AS fx,
        (ln(tan(pi() / 4 + radians({CONUS.north}) / 2)) - ln(tan(pi() / 4 + radians(lat) / 2))) / (ln(tan(pi() / 4 + radians({CONUS.north}) / 2)) - ln(tan(pi() / 4 + radians({CONUS.south}) / 2))) * {LAST_ROW} AS fy FROM e),
    c AS (SELECT *, floor(fx) AS x0, floor(fy) AS y0 FROM p WHERE fx BETWEEN 0 AND {LAST_COL} AND fy BETWEEN 0 AND {LAST_ROW}),
    t AS (SELECT point, least(x0 + dx, {LAST_COL}) AS x, least(y0 + dy, {LAST_ROW}) AS y, (CASE dx WHEN 0 THEN 1 - (fx - x0) ELSE fx - x0 END) * (CASE dy WHEN 0 THEN 1 - (fy - y0) ELSE fy - y0 END) AS w
        FROM c, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy))
    SELECT point, round(sum(h.v * w) / nullif(sum(CASE WHEN h.v IS NOT NULL THEN w END), 0), 4) AS value FROM t LEFT JOIN hcrop h ON h.row = t.y AND h.col = t.x WHERE w > 0 GROUP BY point""",
)
def hover_point_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    cells, rows, cols = raster(spark, sf_dir, True)
    fx, fy = resample.position(CONUS.south - 2 + (e * 37 % 1000) * 0.036, CONUS.west - 2 + (e * 91 % 1000) * 0.07, rows, cols, CONUS)
    points = table(spark, sf_dir, "events").select(e.alias("point"), fx.alias("fx"), fy.alias("fy"))
    return resample.sample(points, cells, rows, cols).select("point", F.round("value", 4).alias("value"))


@query(
    "quantise_int16",
    f"WITH {HOLED_SQL} SELECT row, col, CAST(coalesce(CASE WHEN v IS NOT NULL THEN greatest(-32767, least(32767, floor((v * 18000 - 459.67) / 0.05 + 0.5))) END, -32768) AS SMALLINT) AS code FROM holed",
)
def quantise_int16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holed_grid(spark, sf_dir).select("row", "col", units.quantise(F.col("v") * 18000 - 459.67, F.lit(0.05)).alias("code"))


@query(
    "grid_stats_nearest_rank",
    f"""WITH {HOLED_SQL}, o AS (SELECT row, v, row_number() OVER (PARTITION BY row ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY row) AS n FROM holed WHERE v IS NOT NULL)
    SELECT row, max(n) AS n, min(v) AS min, max(v) AS max, max(v) FILTER (k = floor((n - 1) * 0.5 + 0.5)) AS p50, max(v) FILTER (k = floor((n - 1) * 0.9 + 0.5)) AS p90,
        max(v) FILTER (k = floor((n - 1) * 0.99 + 0.5)) AS p99, round(100.0 * count(*) FILTER (v >= 0.1) / max(n), 6) AS clamp_percent FROM o GROUP BY row""",
)
def grid_stats_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.nearest_rank_stats(holed_grid(spark, sf_dir), keys=("row",), top=0.1)
    return out.withColumn("clamp_percent", F.round("clamp_percent", 6))


BINS = [(-0.1, "deep"), (-0.05, "low"), (0.0, "mid"), (0.05, "high"), (0.1, "top")]


@query("colour_step_bins", f"WITH {HOLED_SQL} SELECT row, col, CASE WHEN v IS NULL THEN NULL WHEN v < -0.05 THEN 'deep' WHEN v < 0 THEN 'low' WHEN v < 0.05 THEN 'mid' WHEN v < 0.1 THEN 'high' ELSE 'top' END AS bin FROM holed")
def colour_step_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.step_bins(holed_grid(spark, sf_dir), BINS).select("row", "col", "bin")


@query("colour_continuous_lut", f"WITH {HOLED_SQL} SELECT row, col, CAST(CASE WHEN v IS NOT NULL THEN floor(greatest(0.0, least(1.0, (v + 0.3) / 0.6)) * 4095 + 0.5) END AS INTEGER) AS entry FROM holed")
def colour_continuous_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holed_grid(spark, sf_dir).select("row", "col", resample.table_index(F.col("v"), -0.3, 0.3, 4096).alias("entry"))


LEVELS = [-0.1, 0.0, 0.1]
CASES_SQL = HOLED_SQL + """, r AS (SELECT row, col, v AS a, lead(v) OVER (PARTITION BY row ORDER BY col) AS b FROM holed),
    q AS (SELECT *, lead(a) OVER w AS d, lead(b) OVER w AS c FROM r WINDOW w AS (PARTITION BY col ORDER BY row)),
    k AS (SELECT q.*, level, CASE WHEN a >= level THEN 1 ELSE 0 END + CASE WHEN b >= level THEN 2 ELSE 0 END + CASE WHEN c >= level THEN 4 ELSE 0 END + CASE WHEN d >= level THEN 8 ELSE 0 END AS kind
        FROM q, (VALUES (CAST(-0.1 AS DOUBLE)), (0.0), (0.1)) l(level) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL),
    cases AS (SELECT * FROM k WHERE kind NOT IN (0, 15))"""


@query("marching_cases", f'WITH {CASES_SQL} SELECT row, col, level, kind AS "case" FROM cases')
def marching_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contour.cases(holed_grid(spark, sf_dir), LEVELS).select("row", "col", "level", "case")


def _edges_sql() -> str:
    rows = [(k, None, a, b) for k, pairs in contour.SEGMENTS.items() for a, b in pairs] + [(k, high, a, b) for (k, high), pairs in contour.SADDLES.items() for a, b in pairs]
    return ", ".join(f"({k}, {'NULL' if h is None else h}, {a}, {b})" for k, h, a, b in rows)


def _ends_sql(e: str, axis: str) -> str:
    share = lambda p, q: f"CASE WHEN {q} = {p} THEN 0.5 ELSE (level - {p}) / ({q} - {p}) END"
    if axis == "x":
        return f"CASE {e} WHEN 0 THEN col + {share('a', 'b')} WHEN 1 THEN col + 1.0 WHEN 2 THEN col + {share('d', 'c')} ELSE col + 0.0 END"
    return f"CASE {e} WHEN 0 THEN row + 0.0 WHEN 1 THEN row + {share('b', 'c')} WHEN 2 THEN row + 1.0 ELSE row + {share('a', 'd')} END"


@query(
    "marching_segments",
    f"""WITH {CASES_SQL}, e(kind, high, p, q) AS (VALUES {_edges_sql()})
    SELECT level, row, col, round({_ends_sql("p", "x")}, 5) AS x1, round({_ends_sql("p", "y")}, 5) AS y1, round({_ends_sql("q", "x")}, 5) AS x2, round({_ends_sql("q", "y")}, 5) AS y2
    FROM cases JOIN e ON cases.kind = e.kind AND (high IS NULL OR high = ((a + b + c + d) / 4 >= level))""",
)
def marching_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = contour.segments(holed_grid(spark, sf_dir), LEVELS)
    return lines.select("level", "row", "col", *[F.round(c, 5).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    "contour_label_topn",
    """WITH l AS (SELECT l_suppkey AS level, l_orderkey AS line, max(l_quantity) AS length FROM lineitem GROUP BY 1, 2),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY level ORDER BY length DESC, line) AS INTEGER) AS place FROM l) SELECT * FROM k WHERE place <= 3""",
)
def contour_label_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("level"), F.col("l_orderkey").alias("line")).agg(F.max("l_quantity").alias("length"))
    return contour.longest_by_value(lines, 3, ("level",))


@query(
    "wind_speed_dir",
    f"""WITH {GRID_SQL}, p AS (SELECT row, col, 100 * v AS u, 100 * lead(v) OVER (PARTITION BY row ORDER BY col) AS w FROM grid)
    SELECT row, col, round(sqrt(u * u + w * w) * 1.943844, 6) AS speed, round(CASE WHEN degrees(atan2(-u, -w)) + 360 >= 360 THEN degrees(atan2(-u, -w)) ELSE degrees(atan2(-u, -w)) + 360 END, 6) AS direction FROM p""",
)
def wind_speed_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = grid(spark, sf_dir).select("row", "col", (100 * F.col("v")).alias("u"), (100 * F.lead("v").over(Window.partitionBy("row").orderBy("col"))).alias("w"))
    return pairs.select("row", "col", F.round(units.wind_speed(F.col("u"), F.col("w")), 6).alias("speed"), F.round(units.wind_direction(F.col("u"), F.col("w")), 6).alias("direction"))


# Tiles of 24 cells, so that even the smallest raster has several in each direction.
TILE_SIDE = 24


@query("tiled_smoothing", SMOOTH_SQL)
def tiled_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as over whole rows and columns, tile by tile."""
    out = tiles.over_tiles(holed_grid(spark, sf_dir), 2, lambda cells, keys: stencil.smooth(cells, keys=keys), side=TILE_SIDE)
    return out.select("row", "col", F.round("smoothed", 6).alias("smoothed"))


@query("tiled_blur", BLUR_SQL)
def tiled_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A halo of the blur's radius."""
    out = tiles.over_tiles(holed_grid(spark, sf_dir), 3, lambda cells, keys: stencil.gaussian_blur(cells, 1.5, 3, keys=keys), side=TILE_SIDE)
    return out.select("row", "col", F.round("blurred", 6).alias("blurred"))


@query("tiled_extrema", ORACLE_SQL["pressure_extrema"])
def tiled_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A halo of the neighbourhood's reach."""
    out = tiles.over_tiles(grid(spark, sf_dir), 4, lambda cells, keys: stencil.extrema(cells, keys=keys), side=TILE_SIDE)
    return out.select("row", "col", F.round("v", 6).alias("v"), "kind")


def drawn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, line, value, place, x, y: an order's items as the points of a line, 40 frames."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("place")).agg(F.max("l_quantity").alias("x"), F.max("l_partkey").alias("part"))
    return rows.select((F.col("line") % 40).alias("frame"), "line", (F.col("line") % 7).alias("value"), "place", F.col("x").cast("double").alias("x"), (F.col("part") % 83 * 0.5).cast("double").alias("y"))


CANDIDATES_SQL = f"""WITH p AS (SELECT l_orderkey % 40 AS frame, l_orderkey AS line, l_linenumber AS place, max(l_quantity) AS x, max(l_partkey) % 83 * 0.5::DOUBLE AS y FROM lineitem GROUP BY l_orderkey, l_linenumber),
    s AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY line ORDER BY place)),
    t AS (SELECT *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS size FROM s WHERE x2 IS NOT NULL),
    u AS (SELECT *, sum(size) OVER (PARTITION BY line ORDER BY place) AS upto, sum(size) OVER (PARTITION BY line) AS whole FROM t),
    c AS (SELECT *, unnest({list(labels.SHARES)!r}) AS share, unnest(range({len(labels.SHARES)})) AS turn FROM u WHERE size > 0)
    SELECT frame, line, turn, round(x + (x2 - x) * (share * whole - upto + size) / size, 4) AS x, round(y + (y2 - y) * (share * whole - upto + size) / size, 4) AS y FROM c WHERE share * whole > upto - size AND share * whole <= upto"""


@query("line_label_candidates", CANDIDATES_SQL)
def line_label_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line's label may stand."""
    return labels.candidates(drawn_lines(spark, sf_dir)).select("frame", "line", "turn", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("line_labels")
def line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label for each line that has room, frame by frame; placing is greedy, in the order of lines."""
    return labels.line_labels(drawn_lines(spark, sf_dir), 2.0, (1.0, 1.0, 49.0, 40.0))
