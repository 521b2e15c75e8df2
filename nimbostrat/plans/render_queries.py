"""Queries of visible ranges, colours, levels and centres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbostrat.operators import render, stencil
from nimbostrat.plans.grid_queries import raster
from nimbostrat.plans.registry import query
from nimbostrat.sources.proxies import GRID_SQL, HOLED_SQL, SERIES_SQL, grid, holed_grid, series, table

UNITS = ["F", " C", "hPa", "in", "in/hr", "%", "mph", "kt", "dBZ", "mi", "mm", "ft", "m", "J/kg", "m2/s2", "K", ""]
SCALE_SQL = "CASE WHEN trim(unit) IN ('F', 'C', 'hPa') THEN 0.05 WHEN trim(unit) = 'in' THEN 0.01 WHEN trim(unit) = 'in/hr' THEN 0.001 WHEN trim(unit) = 'ft' THEN 5 WHEN trim(unit) IN ('m', 'J/kg', 'm2/s2') THEN 1 ELSE 0.1 END::DOUBLE"


@query(
    "hover_quantise_units",
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 11 <> 0 THEN l_quantity * 40 - 900.25 END AS v, ([{", ".join(repr(u) for u in UNITS)}])[CAST(l_partkey % {len(UNITS)} + 1 AS INTEGER)] AS unit FROM lineitem)
    SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, {SCALE_SQL} AS scale, CAST(CASE WHEN v IS NULL THEN -32768 ELSE greatest(-32767, least(32767, floor(v / {SCALE_SQL} + 0.5))) END AS INTEGER) AS code FROM x""",
)
def hover_quantise_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes at the step of each value's unit."""
    names = F.array(*[F.lit(u) for u in UNITS])
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_partkey") % 11 != 0, F.col("l_quantity") * 40 - 900.25).alias("v"), F.element_at(names, (F.col("l_partkey") % len(UNITS) + 1).cast("int")).alias("unit"))
    scale = render.scale_of(F.col("unit"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scale.alias("scale"), render.quantised(F.col("v"), scale).alias("code")).distinct()


@query(
    "hover_quantise_wind",
    f"""WITH {HOLED_SQL}, w AS (SELECT row, col, v * 200 AS u, lead(v) OVER (PARTITION BY row ORDER BY col) * 150 AS w FROM holed)
    SELECT row, col, CAST(CASE WHEN u IS NULL OR w IS NULL THEN -32768 ELSE least(32767, floor(sqrt(u * u + w * w) * 2.2369362920544 / 0.1 + 0.5)) END AS INTEGER) AS code FROM w""",
)
def hover_quantise_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    ahead = F.lead("v").over(Window.partitionBy("row").orderBy("col"))
    rows = holed_grid(spark, sf_dir).withColumn("w", ahead * 150)
    return rows.select("row", "col", render.quantised_wind(F.col("v") * 200, F.col("w"), F.lit(0.1)).alias("code"))


@query("hover_value_counts", f"WITH {HOLED_SQL} SELECT row, count(v) AS values FROM holed GROUP BY row")
def hover_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holed_grid(spark, sf_dir).groupBy("row").agg(F.count("v").alias("values"))


@query(
    "visible_range",
    f"WITH {HOLED_SQL} SELECT row, col, coalesce(v >= CASE WHEN col % 3 <> 0 THEN -0.05 ELSE v END AND v <= CASE WHEN col % 2 = 0 THEN 0.1 ELSE v END, false) AS visible FROM holed",
)
def visible_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lower bound in two columns of three, an upper one in every other."""
    low, high = F.when(F.col("col") % 3 != 0, -0.05), F.when(F.col("col") % 2 == 0, 0.1)
    return holed_grid(spark, sf_dir).select("row", "col", render.in_range(F.col("v"), low, high).alias("visible"))


GATES = [5, 10, 20, 35]


@query("reflectivity_gates", f"WITH {HOLED_SQL} SELECT row, g AS gate, count(*) FILTER (v * 100 >= g) AS visible FROM holed, (VALUES {', '.join(f'({g})' for g in GATES)}) t(g) GROUP BY 1, 2")
def reflectivity_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.gates(holed_grid(spark, sf_dir).withColumn("value", F.col("v") * 100), GATES, ("row",))


LOWS, HIGHS = [0.0, 10.0, 20.0, 30.0], [8.0, 20.0, 25.0, 40.0]


@query(
    "type_colour_bins",
    f"""WITH {HOLED_SQL}, k AS (SELECT row, col, v * 100 AS v, greatest(len(list_filter({LOWS}::DOUBLE[], lambda x: x <= v * 100)), 1) AS k FROM holed)
    SELECT row, col, CASE WHEN v IS NOT NULL THEN CASE WHEN k = 4 OR v < ({HIGHS}::DOUBLE[])[k] THEN k - 1 ELSE -1 END END AS bin FROM k""",
)
def type_colour_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins with gaps between them."""
    lows, highs = (F.array(*[F.lit(x) for x in xs]) for xs in (LOWS, HIGHS))
    return holed_grid(spark, sf_dir).select("row", "col", render.type_bin(F.col("v") * 100, lows, highs).alias("bin"))


@query(
    "uniform_thresholds",
    """WITH t AS (SELECT o_orderkey, [o_custkey % 5, o_custkey % 5 + o_orderkey % 3, o_custkey % 5 + 2 * (o_orderkey % 3), o_custkey % 5 + 3 * (o_orderkey % 3) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END]::DOUBLE[] AS t FROM orders)
    SELECT o_orderkey, CASE WHEN t[2] > t[1] AND abs(t[4] - t[3] - (t[2] - t[1])) <= 1e-6 THEN t[1] END AS start, CASE WHEN t[2] > t[1] AND abs(t[4] - t[3] - (t[2] - t[1])) <= 1e-6 THEN round(1 / (t[2] - t[1]), 6) END AS scale FROM t""",
)
def uniform_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of four are even by construction, the last one mostly."""
    a, d = F.col("o_custkey") % 5, F.col("o_orderkey") % 3
    steps = F.array(*[x.cast("double") for x in (a, a + d, a + 2 * d, a + 3 * d + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0))])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", render.uniform_steps(steps).alias("u"))
    return rows.select("o_orderkey", "u.start", F.round("u.scale", 6).alias("scale"))


STOPS = [(0.0, 255, 0, 0, 0.0), (0.25, 255, 128, 0, 0.5), (0.5, 0, 255, 64, 1.0), (0.5, 0, 0, 255, 1.0), (1.0, 20, 40, 200, 0.0)]


@query(
    "colour_stop_blend",
    f"""WITH {HOLED_SQL}, s(k, p, r, g, b, a) AS (VALUES {", ".join(f"({k}, {p}::DOUBLE, {r}, {g}, {b}, {a}::DOUBLE)" for k, (p, r, g, b, a) in enumerate(STOPS))}),
    x AS (SELECT row, col, greatest(0, least(1, v * 2 + 0.5)) AS t FROM holed WHERE v IS NOT NULL), y AS (SELECT *, (SELECT max(k) FROM s WHERE p <= t + 1e-12) AS i, (SELECT min(k) FROM s WHERE p > t + 1e-12) AS j FROM x),
    z AS (SELECT row, col, l.r AS r0, l.g AS g0, l.b AS b0, l.a AS a0, h.r AS r1, h.g AS g1, h.b AS b1, h.a AS a1, coalesce(greatest(0, (t - l.p) / nullif(h.p - l.p, 0)), 0) AS f FROM y JOIN s l ON l.k = i JOIN s h ON h.k = coalesce(j, i)),
    w AS (SELECT *, a0 + (a1 - a0) * f AS a FROM z)
    SELECT row, col, CAST(floor(CASE WHEN a <= 1e-9 THEN CASE WHEN f < 0.5 THEN r0 ELSE r1 END ELSE (r0 * a0 + (r1 * a1 - r0 * a0) * f) / a END + 0.5) AS INTEGER) AS r, CAST(floor(CASE WHEN a <= 1e-9 THEN CASE WHEN f < 0.5 THEN g0 ELSE g1 END ELSE (g0 * a0 + (g1 * a1 - g0 * a0) * f) / a END + 0.5) AS INTEGER) AS g,
        CAST(floor(CASE WHEN a <= 1e-9 THEN CASE WHEN f < 0.5 THEN b0 ELSE b1 END ELSE (b0 * a0 + (b1 * a1 - b0 * a0) * f) / a END + 0.5) AS INTEGER) AS b, round(CASE WHEN a <= 1e-9 THEN 0 ELSE a END, 6) AS a FROM w""",
)
def colour_stop_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours weighted by alpha between stops, with a hard break in the middle."""
    rows = holed_grid(spark, sf_dir).where("v IS NOT NULL").select("row", "col", render.colour_at(STOPS, F.col("v") * 2 + 0.5).alias("c"))
    return rows.select("row", "col", "c.r", "c.g", "c.b", F.round("c.a", 6).alias("a"))


@query(
    "contour_level_lists",
    f"""WITH {HOLED_SQL}, r AS (SELECT row, min(v) * 1000 AS lo, max(v) * 1000 AS hi, 10 + row % 20 AS step FROM holed GROUP BY row)
    SELECT row, round(unnest(list_transform(range(CAST(ceil(lo / step) AS BIGINT), CAST(floor(hi / step) AS BIGINT) + 1), lambda k: k * step)), 6)::DOUBLE AS level FROM r""",
)
def contour_level_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known range of each row and the multiples of a step in it."""
    ranges = holed_grid(spark, sf_dir).groupBy("row").agg((F.min("v") * 1000).alias("lo"), (F.max("v") * 1000).alias("hi")).withColumn("step", (10 + F.col("row") % 20).cast("double"))
    return ranges.select("row", F.explode(render.contour_levels(F.col("lo"), F.col("hi"), F.col("step"))).alias("level"))


@query(
    "stepped_level_lists",
    "SELECT o_orderkey, unnest(list_transform(range(0, CAST(floor((o_custkey % 50) / (0.5 + o_orderkey % 4) + 0.001) AS BIGINT) + 1), lambda k: round(o_orderkey % 30 + k * (0.5 + o_orderkey % 4), 6)))::DOUBLE AS level FROM orders",
)
def stepped_level_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, step = (F.col("o_orderkey") % 30).cast("double"), 0.5 + F.col("o_orderkey") % 4
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(render.stepped_levels(low, low + F.col("o_custkey") % 50, step)).alias("level"))


@query(
    "line_midpoints",
    f"""WITH {GRID_SQL}, p AS (SELECT row, col AS k, col + v * 4 AS x, v * 30 AS y FROM grid), s AS (SELECT row, k, x, y, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM p WINDOW w AS (PARTITION BY row ORDER BY k)),
    d AS (SELECT *, sqrt(dx * dx + dy * dy) AS n FROM s WHERE dx IS NOT NULL), g AS (SELECT *, sum(n) OVER (PARTITION BY row ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY row) AS whole FROM d),
    f AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY k) AS i FROM g WHERE upto >= whole / 2 AND n > 0)
    SELECT row, round(x + dx * (whole / 2 - (upto - n)) / n, 4) AS x, round(y + dy * (whole / 2 - (upto - n)) / n, 4) AS y, round(degrees(atan2(dy, dx)), 3) AS angle FROM f WHERE i = 1""",
)
def line_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of the raster as a line."""
    points = grid(spark, sf_dir).select("row", F.col("col").alias("k"), (F.col("col") + F.col("v") * 4).alias("x"), (F.col("v") * 30).alias("y"))
    rows = render.line_midpoints(points, ("row",))
    return rows.select("row", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("angle", 3).alias("angle"))


@query(
    "pressure_global_extrema",
    f"""WITH {HOLED_SQL}, b AS (SELECT greatest(2, least(8, floor(least((SELECT max(row) + 1 FROM grid), (SELECT max(col) + 1 FROM grid)) / 28.0 + 0.5))) AS m, (SELECT max(row) FROM grid) AS r, (SELECT max(col) FROM grid) AS c),
    x AS (SELECT holed.* FROM holed, b WHERE row BETWEEN m AND r - m AND col BETWEEN m AND c - m AND v IS NOT NULL)
    (SELECT 'high' AS kind, row, col, round(v, 6) AS value FROM x ORDER BY v DESC, row, col LIMIT 1) UNION ALL (SELECT 'low', row, col, round(v, 6) FROM x ORDER BY v, row, col LIMIT 1)""",
)
def pressure_global_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, rows, cols = raster(spark, sf_dir, True)
    return render.global_extrema(cells, rows, cols).select("kind", "row", "col", F.round("value", 6).alias("value"))


CENTRES_SQL = GRID_SQL + """, l AS (SELECT *, count(v) OVER a AS n1, max(v) OVER a AS h1, min(v) OVER a AS l1 FROM grid WINDOW a AS (PARTITION BY row ORDER BY col ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
    f AS (SELECT row, col, v, sum(n1) OVER b AS n, max(h1) OVER b AS hi, min(l1) OVER b AS lo FROM l WINDOW b AS (PARTITION BY col ORDER BY row ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
    k AS (SELECT row, col, v, CASE WHEN v >= hi - 0.03 AND v - lo > 0.04 THEN 'high' WHEN v <= lo + 0.03 AND hi - v > 0.04 THEN 'low' END AS kind FROM f WHERE n = 81), ce AS (SELECT * FROM k WHERE kind IS NOT NULL)"""


@query(
    "pressure_centres_refined",
    f"""WITH {CENTRES_SQL}, n AS (SELECT c.kind, c.row AS r0, c.col AS c0, g.row, g.col, g.v, row_number() OVER (PARTITION BY c.kind, c.row, c.col ORDER BY CASE c.kind WHEN 'low' THEN g.v ELSE -g.v END, g.row <> c.row OR g.col <> c.col, g.row, g.col) AS k
        FROM ce c, (SELECT unnest(range(-2, 3)) AS dr), (SELECT unnest(range(-2, 3)) AS dc) JOIN grid g ON g.row = c.row + dr AND g.col = c.col + dc)
    SELECT kind, r0 AS row, c0 AS col, row AS to_row, col AS to_col, round(v, 6) AS value FROM n WHERE k = 1""",
)
def pressure_centres_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    return render.refined(stencil.extrema(cells).select("kind", "row", "col"), cells).withColumn("value", F.round("value", 6))


@query(
    "pressure_centres_apart",
    f"""WITH {CENTRES_SQL}, s AS (SELECT *, abs(v) + 0.01 * (row % 3) AS s FROM ce)
    SELECT kind, row, col, NOT EXISTS (SELECT 1 FROM s o WHERE o.kind <> s.kind AND (o.row - s.row) * (o.row - s.row) + (o.col - s.col) * (o.col - s.col) < 36 AND CASE s.kind WHEN 'high' THEN o.s > s.s ELSE o.s >= s.s END) AS kept FROM s""",
)
def pressure_centres_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highs and lows nearer than six cells: the stronger stays."""
    centres = stencil.extrema(grid(spark, sf_dir)).select("kind", "row", "col", F.col("v").alias("value"), (0.01 * (F.col("row") % 3)).alias("prominence"))
    return render.apart(centres, 6, mean=0.0).select("kind", "row", "col", "kept")


@query(
    "precip_rate_types",
    f"""WITH {SERIES_SQL}, m AS (SELECT cell, hour, sum(value) / 4e5 AS rate, count(*) FILTER (model = 'click') * 0.5 AS rain, count(*) FILTER (model = 'view') * 0.5 AS snow, count(*) FILTER (model = 'purchase') * 0.5 AS freezing, count(*) FILTER (model = 'signup') * 0.5 AS sleet FROM series GROUP BY 1, 2),
    r AS (SELECT *, rate * 141.73228346456693 AS inches FROM m) SELECT cell, hour, CASE WHEN inches >= 0.01 THEN CASE WHEN freezing >= 0.5 THEN 'freezing' WHEN sleet >= 0.5 THEN 'sleet' WHEN snow >= 0.5 THEN 'snow' WHEN rain >= 0.5 THEN 'rain' END END AS kind,
        CASE WHEN inches >= 0.01 THEN len(list_filter([0.01, 0.05, 0.1, 0.2]::DOUBLE[], lambda x: x <= inches)) - 1 END AS step FROM r""",
)
def precip_rate_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates in inches an hour by phase; below a hundredth nothing is shown."""
    from nimbostrat.functions import winter

    of = lambda m: F.count_if(F.col("model") == m) * 0.5
    rows = series(spark, sf_dir).groupBy("cell", "hour").agg((F.sum("value") / 4e5 * 141.73228346456693).alias("inches"), of("click").alias("rain"), of("view").alias("snow"), of("purchase").alias("freezing"), of("signup").alias("sleet"))
    shown, steps = F.col("inches") >= 0.01, F.array(*[F.lit(x) for x in (0.01, 0.05, 0.1, 0.2)])
    kind = winter.precip_type(*[F.col(k) for k in ("rain", "snow", "freezing", "sleet")])
    return rows.select("cell", "hour", F.when(shown, kind).alias("kind"), F.when(shown, F.size(F.filter(steps, lambda x: x <= F.col("inches"))) - 1).alias("step"))
