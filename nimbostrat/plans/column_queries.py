"""Queries over whole columns: effective layers, parcels by both integrators, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbostrat.operators import ascent, column, effective, forest
from nimbostrat.plans.profile_queries import FEATURE_HEIGHTS, LAYERS_SQL, TOP_SQL
from nimbostrat.plans.registry import query
from nimbostrat.sources.proxies import SOUNDINGS_SQL, soundings, table


def given_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell and its CAPE and CIN fields, from the order of the same key."""
    price, who = F.col("o_totalprice"), F.col("o_custkey") % 300
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("cell"), (price / 100 - 900).alias("mucape"), (price / 120 - 900).alias("mlcape"), (price / 110 - 950).alias("sbcape"),
        F.when(who % 17 != 0, -who.cast("double")).alias("mlcin"), (-who / 2).cast("double").alias("sbcin"),
    )


# A layer for each cell, made of its order, in place of the search that SQL can't express.
LAYER_SQL = """lay AS (SELECT o_orderkey AS cell, CAST(o_custkey % 7 * 200 AS DOUBLE) AS base_m, CAST(o_custkey % 7 * 200 + o_custkey % 5 * 300 AS DOUBLE) AS top_m,
    o_totalprice / 100 AS most_cape, CASE WHEN o_custkey % 11 <> 0 THEN CAST(o_custkey % 7 * 200 + o_custkey % 13 * 700 AS DOUBLE) END AS el_m FROM orders)"""


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, base = F.col("o_custkey"), F.col("o_custkey") % 7 * 200
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("cell"), base.cast("double").alias("base_m"), (base + c % 5 * 300).cast("double").alias("top_m"),
        (F.col("o_totalprice") / 100).alias("most_cape"), F.when(c % 11 != 0, (base + c % 13 * 700).cast("double")).alias("el_m"),
    )


def _at(name: str, height: str) -> str:
    """A CTE of p, u and v of each cell at a height of ``lx``."""
    return f"""{name} AS (SELECT cell, agl AS h, CASE WHEN l.agl = {height} THEN p ELSE exp(ln(p) + (ln(p2) - ln(p)) * ({height} - l.agl) / (agl2 - l.agl)) END AS p,
        CASE WHEN l.agl = {height} THEN u ELSE u + ({height} - l.agl) / (agl2 - l.agl) * (u2 - u) END AS u, CASE WHEN l.agl = {height} THEN v ELSE v + ({height} - l.agl) / (agl2 - l.agl) * (v2 - v) END AS v
        FROM ly l JOIN lx USING (cell) WHERE l.agl <= {height} AND (agl2 > {height} OR l.agl = {height}))"""


def _mean(name: str, low: str, high: str, weight: str) -> str:
    w = (lambda p: p) if weight else (lambda p: "1.0")
    part = lambda c: f"sum(({w('p')} * {c} + 4 * {w('pm')} * ({c} + ({c}2 - {c}) * s) + {w('p2')} * {c}2) / 6 * (p - p2)) / sum(({w('p')} + 4 * {w('pm')} + {w('p2')}) / 6 * (p - p2)) AS {c}"
    return f"""{name}_s AS (SELECT cell, p, u, v FROM {low} WHERE cell IN (SELECT cell FROM {high}) UNION ALL SELECT pr.cell, pr.p, pr.u, pr.v FROM pr JOIN {low} a ON a.cell = pr.cell JOIN {high} b ON b.cell = pr.cell WHERE pr.p < a.p AND pr.p > b.p
            UNION ALL SELECT cell, p, u, v FROM {high} WHERE cell IN (SELECT cell FROM {low})),
        {name} AS (SELECT cell, {part("u")}, {part("v")} FROM (SELECT *, (p + p2) / 2 AS pm, (ln((p + p2) / 2) - ln(p)) / (ln(p2) - ln(p)) AS s FROM (
            SELECT *, lead(p) OVER w AS p2, lead(u) OVER w AS u2, lead(v) OVER w AS v2 FROM {name}_s WINDOW w AS (PARTITION BY cell ORDER BY p DESC)) WHERE p2 < p) GROUP BY cell)"""


KINEMATICS_SQL = f"""WITH {LAYERS_SQL}, {LAYER_SQL},
    lx AS (SELECT *, greatest(top_m, base_m + 1) AS top, CASE WHEN most_cape > 100 AND el_m > base_m + 500 AND base_m + (el_m - base_m) * 0.65 >= 3000 THEN base_m + (el_m - base_m) * 0.65 END AS deep,
        base_m + 0.5 * greatest(0, coalesce(el_m, greatest(top_m, base_m + 1)) - base_m) AS half, 0.0 AS zero, 6000.0 AS six FROM lay),
    {_at("a", "base_m")}, {_at("t", "top")}, {_at("b", "half")}, {_at("d", "deep")}, {_at("z", "zero")}, {_at("s6", "six")},
    {_mean("mo", "a", "d", "p")}, {_mean("m6", "z", "s6", "")},
    g AS (SELECT m.cell, m.u + 7.5 * (d.v - a.v) / n AS u, m.v - 7.5 * (d.u - a.u) / n AS v FROM mo m JOIN a USING (cell) JOIN d USING (cell), LATERAL (SELECT sqrt((d.u - a.u) * (d.u - a.u) + (d.v - a.v) * (d.v - a.v)) AS n) WHERE n >= 1e-6),
    g6 AS (SELECT m.cell, m.u + 7.5 * (d.v - a.v) / n AS u, m.v - 7.5 * (d.u - a.u) / n AS v FROM m6 m JOIN z a USING (cell) JOIN s6 d USING (cell), LATERAL (SELECT sqrt((d.u - a.u) * (d.u - a.u) + (d.v - a.v) * (d.v - a.v)) AS n) WHERE n >= 1e-6),
    c AS (SELECT lx.cell, coalesce(g.u, g6.u) AS cu, coalesce(g.v, g6.v) AS cv FROM lx LEFT JOIN g USING (cell) LEFT JOIN g6 USING (cell)),
    w AS (SELECT cell, base_m AS h, u, v FROM a JOIN lx USING (cell) WHERE cell IN (SELECT cell FROM t) UNION ALL SELECT cell, agl, u, v FROM pr JOIN lx USING (cell) WHERE agl > base_m AND agl < top AND cell IN (SELECT cell FROM a) AND cell IN (SELECT cell FROM t) UNION ALL SELECT cell, top, u, v FROM t JOIN lx USING (cell) WHERE cell IN (SELECT cell FROM a)),
    e AS (SELECT cell, sum((u2 - cu) * (v - cv) - (u - cu) * (v2 - cv)) AS esrh FROM (SELECT *, lead(u) OVER q AS u2, lead(v) OVER q AS v2 FROM w WINDOW q AS (PARTITION BY cell ORDER BY h)) JOIN c USING (cell) WHERE u2 IS NOT NULL GROUP BY cell)
    SELECT lx.cell, round(cu, 4) + 0.0 AS motion_u, round(cv, 4) + 0.0 AS motion_v, round(esrh, 3) + 0.0 AS esrh, round(sqrt((b.u - a.u) * (b.u - a.u) + (b.v - a.v) * (b.v - a.v)) * 1.943844, 4) AS ebwd_kt
    FROM lx JOIN (SELECT DISTINCT cell FROM pr) USING (cell) LEFT JOIN c USING (cell) LEFT JOIN e USING (cell) LEFT JOIN a ON a.cell = lx.cell LEFT JOIN b ON b.cell = lx.cell"""


@query("effective_kinematics", KINEMATICS_SQL)
def effective_kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion, helicity and shear of layers whose bottom and top differ by cell."""
    rows = column.columns(soundings(spark, sf_dir)).join(layers(spark, sf_dir), "cell")
    out = effective.kinematics(rows)
    return out.select("cell", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("motion_u", 4), ("motion_v", 4), ("esrh", 3), ("ebwd_kt", 4))])


@query("effective_products")
def effective_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer, motion, helicity, shear and composites of the candidate cells; the search is iterative."""
    return effective.effective_products(soundings(spark, sf_dir), given_fields(spark, sf_dir))


DERIVED_SQL = f"""WITH {LAYERS_SQL}, a AS ({TOP_SQL.format(h=6000)}),
    w AS (SELECT cell, CASE WHEN agl = 3000 THEN t ELSE t + (3000 - agl) / (agl2 - agl) * (t2 - t) END AS t3 FROM ly WHERE agl <= 3000 AND (agl2 > 3000 OR agl = 3000)),
    b AS (SELECT cell, t AS t0, u AS u0, v AS v0, count(*) OVER (PARTITION BY cell) AS n, k FROM pr QUALIFY k = 1),
    f AS (SELECT o_orderkey AS cell, o_totalprice / 100 - 900 AS mu, o_totalprice / 120 - 900 AS ml, o_totalprice / 110 - 950 AS sb, CASE WHEN o_custkey % 300 % 17 <> 0 THEN -(o_custkey % 300) END AS mi, -(o_custkey % 300) / 2 AS si FROM orders)
    SELECT b.cell, coalesce(mu >= 100 OR (ml > 0 AND coalesce(mi > -200, true) AND (mu >= 100 OR ml >= 100 OR sb >= 100)), false) AND n >= 3 AS searched, round((t0 - t3) / 3, 5) + 0.0 AS lapse_0_3km,
        round(sqrt((a.u - u0) * (a.u - u0) + (a.v - v0) * (a.v - v0)) * 1.943844, 4) AS shear_0_6km_kt,
        CASE WHEN coalesce(ml >= 100 AND mi >= -250, false) OR coalesce(sb >= 100 AND si >= -250, false) THEN round(sqrt((a.u - u0) * (a.u - u0) + (a.v - v0) * (a.v - v0)) * 1.943844, 4) END AS shear_effective_kt
    FROM b LEFT JOIN f USING (cell) LEFT JOIN a ON a.cell = b.cell LEFT JOIN w ON w.cell = b.cell"""


@query("profile_gates", DERIVED_SQL)
def profile_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cells are searched, and the derived fields that need no iteration."""
    out = effective.profile_derived_grids(soundings(spark, sf_dir), given_fields(spark, sf_dir))
    return out.select("cell", "searched", (F.round("lapse_0_3km", 5) + 0.0).alias("lapse_0_3km"), *[F.round(c, 4).alias(c) for c in ("shear_0_6km_kt", "shear_effective_kt")])


@query("profile_derived_grids")
def profile_derived_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All derived fields of all cells in one pass; only gated cells go through the search."""
    return effective.profile_derived_grids(soundings(spark, sf_dir), given_fields(spark, sf_dir))


@query("parcel_pressure_steps")
def parcel_pressure_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAPE, CIN and their levels by layers and by hectopascals."""
    return ascent.both_integrators(soundings(spark, sf_dir))


@query("parcel_trace")
def parcel_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest parcel's path, every 25 hPa, at the levels and at condensation: one row a sample."""
    rows = ascent.parcel_traces(soundings(spark, sf_dir))
    samples = F.arrays_zip("p", "t", "tv", "dewpoint", "env_tv")
    out = rows.select("cell", F.posexplode(samples).alias("k", "s")).select("cell", "k", "s.*")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("t", "tv", "dewpoint", "env_tv")})


@query("moist_adiabats")
def moist_adiabats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature of saturated air of each level's equivalent potential temperature, at that level."""
    from nimbostrat.functions import thermo

    rows = soundings(spark, sf_dir)
    rows = rows.withColumn("theta_e", thermo.theta_e(F.col("t"), F.least(thermo.dewpoint_from_rh(F.col("t"), F.col("rh")), F.col("t")), F.col("p")))
    return ascent.moist_adiabats(rows, F.col("theta_e"), F.col("p")).select("cell", "p", "theta_e", "adiabat")


# A forest from the parts: 63 of them make a tree in heap order; the last one is incomplete.
TREE = 63


def forest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree, node, left, right, feature, threshold, value; a child that isn't there ends the walk."""
    at = F.col("p_partkey")
    feature, value = F.col("p_partkey") * 7 % 24, F.col("p_partkey") % 40 + 1
    low = F.when(feature < 8, F.col("p_partkey") * 13 % 30).when(feature < 16, 270 + F.col("p_partkey") * 11 % 30).otherwise(20 + F.col("p_partkey") * 17 % 80)
    rows = table(spark, sf_dir, "part").select(F.floor(at / TREE).alias("tree"), (at % TREE).alias("node"), feature.alias("feature"), (low + 0.37).alias("threshold"), value.cast("double").alias("value"))
    return rows.select("*", (F.col("node") * 2 + 1).alias("left"), (F.col("node") * 2 + 2).alias("right"))


FOREST_SQL = f"""WITH RECURSIVE {SOUNDINGS_SQL}, b AS (SELECT cell, z - min(z) OVER (PARTITION BY cell) AS agl, sqrt(u * u + v * v) AS spd, t, rh FROM soundings),
    l AS (SELECT *, lead(agl) OVER w AS agl2, lead(spd) OVER w AS spd2, lead(t) OVER w AS t2, lead(rh) OVER w AS rh2 FROM b WINDOW w AS (PARTITION BY cell ORDER BY agl)),
    h AS (SELECT unnest({FEATURE_HEIGHTS}) AS h), y AS (SELECT cell, h, spd + (spd2 - spd) * s AS spd, t + (t2 - t) * s AS t, rh + (rh2 - rh) * s AS rh FROM (SELECT *, (h - agl) / (agl2 - agl) AS s FROM l, h WHERE agl <= h AND agl2 > h)),
    f AS (SELECT cell, list(spd ORDER BY h) || list(t ORDER BY h) || list(rh ORDER BY h) AS x FROM y GROUP BY cell HAVING count(*) = {len(FEATURE_HEIGHTS)} AND count(rh) = {len(FEATURE_HEIGHTS)}),
    n AS (SELECT p_partkey // {TREE} AS tree, p_partkey % {TREE} AS k, p_partkey * 7 % 24 AS feature, CASE WHEN p_partkey * 7 % 24 < 8 THEN p_partkey * 13 % 30 WHEN p_partkey * 7 % 24 < 16 THEN 270 + p_partkey * 11 % 30 ELSE 20 + p_partkey * 17 % 80 END + 0.37::DOUBLE AS threshold, (p_partkey % 40 + 1)::DOUBLE AS value FROM part),
    m AS (SELECT n.*, r.k IS NOT NULL AS inner_ FROM n LEFT JOIN n r ON r.tree = n.tree AND r.k = 2 * n.k + 2),
    w AS (SELECT cell, tree, k, value, inner_, CASE WHEN x[feature + 1] <= threshold THEN 2 * k + 1 ELSE 2 * k + 2 END AS next FROM f, m WHERE k = 0
        UNION ALL SELECT w.cell, w.tree, m.k, m.value, m.inner_, CASE WHEN f.x[m.feature + 1] <= m.threshold THEN 2 * m.k + 1 ELSE 2 * m.k + 2 END FROM w JOIN m ON m.tree = w.tree AND m.k = w.next JOIN f ON f.cell = w.cell WHERE w.inner_),
    v AS (SELECT cell, avg(value) AS ratio FROM w WHERE NOT inner_ GROUP BY cell)
    SELECT c.cell, round(v.ratio, 6) AS ratio FROM (SELECT DISTINCT cell FROM soundings) c LEFT JOIN v USING (cell)"""


@query("forest_ratio", FOREST_SQL)
def forest_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snow ratios by a forest read from a table, over the speed, temperature and humidity of eight heights."""
    cells = column.agl_features(soundings(spark, sf_dir), FEATURE_HEIGHTS)
    model = forest.forest_from_table(forest_nodes(spark, sf_dir))
    return forest.forest_values(cells, model).select("cell", F.round("ratio", 6).alias("ratio"))
