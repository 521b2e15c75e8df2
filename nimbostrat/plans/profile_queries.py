"""Thermodynamic, severe, winter and profile queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbostrat.functions import severe, thermo, units, winter
from nimbostrat.operators import column, forest, parcel, profile, snow
from nimbostrat.plans.registry import query
from nimbostrat.sources.proxies import SOUNDINGS_SQL, soundings, table

ITEMS_SQL = """items0 AS (
    SELECT l_orderkey AS a, l_linenumber AS b, l_partkey AS c, l_suppkey AS d, l_quantity AS q, l_extendedprice AS e, l_discount AS x, l_tax AS y FROM lineitem)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey a", "l_linenumber b", "l_partkey c", "l_suppkey d", "l_quantity q", "l_extendedprice e", "l_discount x", "l_tax y"
    )


KEYS = ("a", "b", "c", "d", "q")
KEY_SQL = "a, b, c, d, q"


def _out(df: DataFrame, digits: int = 5, **columns) -> DataFrame:
    return df.select(*KEYS, *[F.round(c, digits).alias(n) for n, c in columns.items()])


@query(
    "unit_transforms",
    f"""WITH {ITEMS_SQL} SELECT {KEY_SQL}, round(q * 1.8 - 459.67, 5) AS fahrenheit, round(q - 273.15, 5) AS celsius, round(e / 1609.344, 5) AS miles, round(q / 25.4, 5) AS inches,
    round(greatest(0, e * 3.28084 - 50000), 2) AS feet, round(CASE WHEN b <> 0 THEN greatest(0, q / 25.4 / b) END, 5) AS rate FROM items0""",
)
def unit_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, e = F.col("q"), F.col("e")
    rows = items(spark, sf_dir)
    feet = F.greatest(F.lit(0.0), units.transform(e, "metersToFeet") - 50000)
    return rows.select(
        *KEYS, F.round(units.transform(q, "kelvinToFahrenheit"), 5).alias("fahrenheit"), F.round(units.transform(q, "kelvinToCelsius"), 5).alias("celsius"),
        F.round(units.transform(e, "metersToMiles"), 5).alias("miles"), F.round(units.transform(q, "kgM2ToWaterInches"), 5).alias("inches"),
        F.round(feet, 2).alias("feet"), F.round(units.precip_rate(q, F.col("b")), 5).alias("rate"),
    )


THERMO_SQL = ITEMS_SQL + """, s AS (SELECT *, 270 + q AS t, 265 + q - 60 * x AS td, 1000 - 2000 * y AS p FROM items0),
    v AS (SELECT *, 6.112 * exp(17.67 * (td - 273.15) / (td - 273.15 + 243.5)) AS ev, 6.112 * exp(17.67 * (t - 273.15) / (t - 273.15 + 243.5)) AS es FROM s),
    w AS (SELECT *, 0.622 * ev / (p - ev) AS w, 56 + 1 / (1 / (td - 56) + ln(t / td) / 800) AS tl, greatest(1, least(100, 100 * ev / es)) AS rh FROM v)"""


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T, Td and p of the pseudo-surface."""
    return items(spark, sf_dir).withColumns({"t": 270 + F.col("q"), "td": 265 + F.col("q") - 60 * F.col("x"), "p": 1000 - 2000 * F.col("y")})




@query("theta_e", f"WITH {THERMO_SQL} SELECT {KEY_SQL}, round(t * pow(1000 / (p - ev), 0.2854 * (1 - 0.28 * w)) * exp((3376 / tl - 2.54) * w * (1 + 0.81 * w)), 4) AS theta_e FROM w")
def theta_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(surface(spark, sf_dir), 4, theta_e=thermo.theta_e(F.col("t"), F.col("td"), F.col("p")))


@query("lcl", f"WITH {THERMO_SQL} SELECT {KEY_SQL}, round(tl, 5) AS lcl_k, round(greatest(0, (t - tl) / 0.0098), 3) AS lcl_m FROM w")
def lcl(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, td = F.col("t"), F.col("td")
    return surface(spark, sf_dir).select(*KEYS, F.round(thermo.lcl_temperature(t, td), 5).alias("lcl_k"), F.round(thermo.lcl_height(t, td), 3).alias("lcl_m"))


@query(
    "stull_wet_bulb",
    f"""WITH {THERMO_SQL} SELECT {KEY_SQL}, round((t - 273.15) * atan(0.151977 * sqrt(rh + 8.313659)) + atan(t - 273.15 + rh) - atan(rh - 1.676331) + 0.00391838 * pow(rh, 1.5) * atan(0.023101 * rh) - 4.686035, 5) AS wet_bulb_c FROM w""",
)
def stull_wet_bulb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(surface(spark, sf_dir), wet_bulb_c=thermo.wet_bulb_c(F.col("t"), F.col("td")))


@query("mixing_ratio", f"WITH {THERMO_SQL} SELECT {KEY_SQL}, round(w * 1000, 5) AS w, round(w / (1 + w) * 1000, 5) AS q_specific, round(rh, 5) AS rh FROM w")
def mixing_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, td, p = F.col("t"), F.col("td"), F.col("p")
    return _out(surface(spark, sf_dir), w=thermo.mixing_ratio_from_dewpoint(td, p) * 1000, q_specific=thermo.specific_humidity(td, p) * 1000, rh=thermo.relative_humidity(t, td))


@query("virtual_temp", f"WITH {THERMO_SQL} SELECT {KEY_SQL}, round(t * (1 + w / 0.622) / (1 + w), 5) AS tv, round(t * pow(1000 / p, 0.2854), 5) AS theta FROM w")
def virtual_temp(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, td, p = F.col("t"), F.col("td"), F.col("p")
    return _out(surface(spark, sf_dir), tv=thermo.virtual_temperature(t, thermo.mixing_ratio_from_dewpoint(td, p)), theta=thermo.potential_temperature(t, p))


@query(
    "dewpoint_from_rh",
    f"""WITH {ITEMS_SQL}, g AS (SELECT *, CASE WHEN x > 0.01 THEN ln(least(100, greatest(1, 1000 * x)) / 100) + 17.625 * (q - 3.15) / (q - 3.15 + 243.04) END AS g FROM items0)
    SELECT {KEY_SQL}, round(243.04 * g / (17.625 - g) + 273.15, 5) AS td FROM g""",
)
def dewpoint_from_rh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(items(spark, sf_dir), td=thermo.dewpoint_from_rh(270 + F.col("q"), F.when(F.col("x") > 0.01, 1000 * F.col("x"))))


@query(
    "station_pressure_fallback",
    f"""WITH {ITEMS_SQL}, s AS (SELECT *, CASE WHEN b % 3 = 0 THEN 90000 + q * 100 WHEN b % 3 = 1 THEN 500 END AS sp, 100000 + q * 50 AS msl, q * 40 AS z, CASE WHEN b % 2 = 0 THEN 280 + q * 0.2 END AS t FROM items0)
    SELECT {KEY_SQL}, round(coalesce(CASE WHEN sp > 1000 THEN sp / 100 END, CASE WHEN z > 1 AND t + 0.0065 * z > 0 THEN msl / 100 * pow(1 - 0.0065 * z / (t + 0.0065 * z), 5.257) END, msl / 100), 5) AS p FROM s""",
)
def station_pressure_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = F.col("b"), F.col("q")
    sp = F.when(b % 3 == 0, 90000 + q * 100).when(b % 3 == 1, 500)
    return _out(items(spark, sf_dir), p=thermo.station_pressure(sp, 100000 + q * 50, q * 40, F.when(b % 2 == 0, 280 + q * 0.2)))


@query(
    "scp_stp_fixed",
    f"""WITH {ITEMS_SQL}, s AS (SELECT *, q * 80 AS cape, x * 4000 AS srh, y * 800 AS shear, e / 30 AS lclm FROM items0), m AS (SELECT *, greatest(0, shear) / 1.943844 AS ms FROM s)
    SELECT {KEY_SQL}, round(cape / 1000 * (srh / 50) * CASE WHEN ms < 10 THEN 0 ELSE least(1, ms / 20) END, 6) AS scp,
        round(cape / 1500 * (srh / 150) * greatest(0, least(1, (2000 - lclm) / 1000)) * CASE WHEN ms < 12.5 THEN 0 ELSE least(1.5, ms / 20) END, 6) AS stp FROM m""",
)
def scp_stp_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cape, srh, shear, lcl_m = F.col("q") * 80, F.col("x") * 4000, F.col("y") * 800, F.col("e") / 30
    return _out(items(spark, sf_dir), 6, scp=severe.supercell_composite(cape, srh, shear), stp=severe.tornado_parameter(cape, srh, lcl_m, shear))


@query(
    "stp_effective",
    f"""WITH {ITEMS_SQL}, s AS (SELECT *, q * 80 AS cape, -x * 2500 AS cin, e / 30 AS lclm, q * 6 AS esrh, y * 800 / 1.943844 AS ms, CASE WHEN b % 4 = 0 THEN 500.0 WHEN b % 4 = 1 THEN 0.0 END AS base FROM items0)
    SELECT {KEY_SQL}, round(CASE WHEN base > 0 THEN 0 ELSE cape / 1500 * (esrh / 150) * greatest(0, least(1, (2000 - lclm) / 1000)) * CASE WHEN ms < 12.5 THEN 0 ELSE least(1.5, ms / 20) END
        * CASE WHEN cin > -50 THEN 1 ELSE greatest(0, least(1, (cin + 200) / 150)) END END, 6) AS stp FROM s""",
)
def stp_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q = F.col("b"), F.col("q")
    base = F.when(b % 4 == 0, 500.0).when(b % 4 == 1, 0.0)
    return _out(items(spark, sf_dir), 6, stp=severe.effective_tornado_parameter(q * 80, -F.col("x") * 2500, F.col("e") / 30, q * 6, F.col("y") * 800, base))


@query(
    "effective_gate",
    f"""WITH {ITEMS_SQL} SELECT {KEY_SQL}, coalesce(q * 5 >= 100 AND -x * 4000 >= -250, false) OR coalesce(CASE WHEN b % 3 <> 0 THEN q * 4 END >= 100 AND -y * 5000 >= -250, false) AS active FROM items0""",
)
def effective_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    gate = severe.effective_candidate(q * 5, -F.col("x") * 4000, F.when(F.col("b") % 3 != 0, q * 4), -F.col("y") * 5000)
    return items(spark, sf_dir).select(*KEYS, gate.alias("active"))


@query(
    "hazard_signal",
    f"""WITH {ITEMS_SQL}, s AS (SELECT *, CASE WHEN b % 5 <> 0 THEN q * 40 END AS cape, x * 30 AS stp, q / 8 AS scp, y * 600 AS shear, e / 200 AS srh, CASE WHEN b = 3 THEN x * 15 END AS hail FROM items0)
    SELECT {KEY_SQL}, CASE WHEN stp >= 2 AND cape >= 500 AND shear >= 30 AND srh >= 100 THEN 'TOR' WHEN stp >= 1 AND cape >= 500 AND shear >= 25 THEN 'TOR?' WHEN scp >= 4 AND cape >= 1000 AND shear >= 35 THEN 'SUP'
        WHEN coalesce(cape >= 1000 AND shear >= 30, false) OR coalesce(hail >= 1, false) THEN 'SVR' WHEN cape >= 250 AND shear >= 25 THEN 'MRGL' ELSE 'NONE' END AS label FROM s""",
)
def hazard_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, q, x = F.col("b"), F.col("q"), F.col("x")
    label = severe.hazard_signal(F.when(b % 5 != 0, q * 40), x * 30, q / 8, F.col("y") * 600, F.col("e") / 200, F.when(b == 3, x * 15))
    return items(spark, sf_dir).select(*KEYS, label.alias("label"))


@query(
    "ship",
    f"""WITH {ITEMS_SQL}, s AS (SELECT *, q * 80 AS cape, greatest(11, least(13.6, (0.008 + x * 0.1) * 1000)) AS w, 4 + q / 10 AS lr, -25 + q * 0.5 AS t5, greatest(7, least(27, y * 1000 / 1.943844)) AS sh, e / 10 AS fz FROM items0),
    a AS (SELECT *, -1 * cape * w * lr * least(t5, -5.5) * sh / 42000000 * CASE WHEN cape < 1300 THEN cape / 1300 ELSE 1 END * CASE WHEN lr < 5.8 THEN lr / 5.8 ELSE 1 END * CASE WHEN fz < 2400 THEN fz / 2400 ELSE 1 END AS v FROM s)
    SELECT {KEY_SQL}, round(greatest(0, v), 6) AS ship FROM a""",
)
def ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    return _out(items(spark, sf_dir), 6, ship=severe.hail_parameter(q * 80, 0.008 + F.col("x") * 0.1, 4 + q / 10, -25 + q * 0.5, F.col("y") * 1000, F.col("e") / 10))


@query("kuchera", f"WITH {ITEMS_SQL} SELECT {KEY_SQL}, round(greatest(3, least(50, CASE WHEN q - 30 > -2 THEN 12 + 2 * (-2 - (q - 30)) ELSE 12 + (-2 - (q - 30)) END)), 6) AS ratio FROM items0")
def kuchera(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(items(spark, sf_dir), 6, ratio=winter.kuchera_ratio(F.col("q") - 30))


def _cobb_sql(t: str) -> str:
    bins = zip(winter.COBB_FROM, winter.COBB_FROM[1:], winter.COBB_C1, winter.COBB_C2, winter.COBB_C3, winter.COBB_C4, strict=False)
    arms = " ".join(f"WHEN {t} < {hi} THEN {c1} + {c2} * ({t} - ({lo})) + {c3} * pow({t} - ({lo}), 2) + {c4} * pow({t} - ({lo}), 3)" for lo, hi, c1, c2, c3, c4 in bins)
    return f"CASE WHEN {t} < {winter.COBB_FROM[0]} THEN {winter.COBB_C1[0]} {arms} WHEN {t} > 3 THEN 0 END"


COBB_SQL = "SELECT *, list_avg([" + ", ".join(_cobb_sql(f"(tc + {k})") for k in (0, 1, 2)) + "]) AS ratio FROM {}"


@query("cobb_layer", f"WITH {ITEMS_SQL}, c AS (SELECT *, q * 0.8 - 32 AS tc FROM items0), r AS ({COBB_SQL.format('c')}) SELECT {KEY_SQL}, round(ratio, 5) AS ratio FROM r")
def cobb_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(items(spark, sf_dir), ratio=winter.cobb_ratio(F.col("q") * 0.8 - 32))


@query(
    "fram_ilr",
    f"""WITH {ITEMS_SQL}, s AS (SELECT *, x * 2 AS rate, greatest(0.02, x * 2) AS p, greatest(-7, q / 5 - 9) AS tw, y * 300 AS v FROM items0),
    k AS (SELECT *, 0.1395 * pow(p, -0.541) AS a1, -0.0071 * tw * tw * tw - 0.1039 * tw * tw - 0.3904 * tw + 0.5545 AS b1, 0.0014 * v * v + 0.0027 * v + 0.7574 AS c1 FROM s)
    SELECT {KEY_SQL}, round(CASE WHEN rate > 0 THEN greatest(0, CASE WHEN tw > -0.35 THEN 0.7 * a1 + 0.29 * b1 + 0.01 * c1 WHEN v > 12 THEN 0.73 * a1 + 0.01 * b1 + 0.26 * c1 ELSE 0.79 * a1 + 0.2 * b1 + 0.01 * c1 END) END, 6) AS ilr FROM k""",
)
def fram_ilr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(items(spark, sf_dir), 6, ilr=winter.ice_liquid_ratio(F.col("x") * 2, F.col("q") / 5 - 9, F.col("y") * 300))


@query("linear_slr", f"WITH {ITEMS_SQL} SELECT {KEY_SQL}, round(10 + 0.2 * q - 30 * x + 12.5 * y, 6) AS slr FROM items0")
def linear_slr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(items(spark, sf_dir), 6, slr=winter.linear_ratio(10.0, [0.2, -30.0, 12.5], [F.col("q"), F.col("x"), F.col("y")]))


LAYERS_SQL = SOUNDINGS_SQL + """, pr AS (SELECT *, z - first_value(z) OVER w AS agl, row_number() OVER w AS k FROM soundings WINDOW w AS (PARTITION BY cell ORDER BY z)),
    ly AS (SELECT *, lead(p) OVER w AS p2, lead(z) OVER w AS z2, lead(agl) OVER w AS agl2, lead(t) OVER w AS t2, lead(u) OVER w AS u2, lead(v) OVER w AS v2 FROM pr WINDOW w AS (PARTITION BY cell ORDER BY z))"""
AT_SQL = "SELECT cell, CASE WHEN agl = {h} THEN u ELSE u + ({h} - agl) / (agl2 - agl) * (u2 - u) END AS u, CASE WHEN agl = {h} THEN v ELSE v + ({h} - agl) / (agl2 - agl) * (v2 - v) END AS v FROM ly WHERE agl <= {h} AND (agl2 > {h} OR agl = {h})"


@query("profile_value_at_agl", f"WITH {LAYERS_SQL}, a AS ({AT_SQL.format(h=3000)}) SELECT cell, round(u, 5) AS u, round(v, 5) AS v FROM a")
def profile_value_at_agl(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.at_height(soundings(spark, sf_dir), 3000.0, ("u", "v"))
    return out.select("cell", F.round("u", 5).alias("u"), F.round("v", 5).alias("v"))


@query(
    "profile_value_at_pressure",
    f"""WITH {LAYERS_SQL} SELECT cell, round(CASE WHEN p = 600 THEN t ELSE t + (ln(p) - ln(600)) / (ln(p) - ln(p2)) * (t2 - t) END, 5) AS t FROM ly WHERE p >= 600 AND (p2 < 600 OR p = 600)""",
)
def profile_value_at_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.at_pressure(soundings(spark, sf_dir), 600.0, ("t",)).select("cell", F.round("t", 5).alias("t"))


@query(
    "freezing_level",
    f"""WITH {LAYERS_SQL} SELECT cell, round(min(CASE WHEN k = 1 AND t <= 273.15 THEN z WHEN t > 273.15 AND t2 <= 273.15 THEN z + (t - 273.15) / (t - t2) * (z2 - z) END), 4) AS freezing_m FROM ly GROUP BY cell""",
)
def freezing_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.freezing_level(soundings(spark, sf_dir)).select("cell", F.round("freezing_m", 4).alias("freezing_m"))


@query(
    "pwat",
    f"""WITH {SOUNDINGS_SQL}, g AS (SELECT *, ln(least(100, greatest(1, rh)) / 100) + 17.625 * (t - 273.15) / (t - 273.15 + 243.04) AS g FROM soundings),
    d AS (SELECT *, 243.04 * g / (17.625 - g) AS tdc FROM g), e AS (SELECT *, 6.112 * exp(17.67 * tdc / (tdc + 243.5)) AS ev FROM d),
    q AS (SELECT cell, p, z, 0.622 * ev / (p - ev) / (1 + 0.622 * ev / (p - ev)) AS q FROM e), l AS (SELECT *, lead(q) OVER w AS q2, lead(p) OVER w AS p2 FROM q WINDOW w AS (PARTITION BY cell ORDER BY z))
    SELECT cell, round(sum((q + q2) / 2 * (p - p2) * (100.0 / 9.80665)), 5) AS pwat_mm FROM l GROUP BY cell""",
)
def pwat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.precipitable_water(soundings(spark, sf_dir)).select("cell", F.round("pwat_mm", 5).alias("pwat_mm"))


# a mean over height counts only where the profile reaches the top
MEAN_SQL = """SELECT cell, sum((u + s * (u2 - u) / 2) * s * (agl2 - agl)) / sum(s * (agl2 - agl)) AS u, sum((v + s * (v2 - v) / 2) * s * (agl2 - agl)) / sum(s * (agl2 - agl)) AS v
    FROM (SELECT *, least(1.0, (6000 - agl) / (agl2 - agl)) AS s FROM ly WHERE agl < 6000 AND agl2 IS NOT NULL) GROUP BY cell HAVING max(agl2) >= 6000"""
# p, u and v at a height; then a mean over pressure of the samples of a CTE, by Simpson's rule
TOP_SQL = """SELECT cell, CASE WHEN agl = {h} THEN p ELSE exp(ln(p) + (ln(p2) - ln(p)) * ({h} - agl) / (agl2 - agl)) END AS p,
    CASE WHEN agl = {h} THEN u ELSE u + ({h} - agl) / (agl2 - agl) * (u2 - u) END AS u, CASE WHEN agl = {h} THEN v ELSE v + ({h} - agl) / (agl2 - agl) * (v2 - v) END AS v FROM ly WHERE agl <= {h} AND (agl2 > {h} OR agl = {h})"""


def _mean_over_pressure(samples: str) -> str:
    part = lambda c: f"sum(({c} + 4 * ({c} + ({c}2 - {c}) * s) + {c}2) / 6 * (p - p2)) / sum(p - p2) AS {c}"
    return f"""SELECT cell, {part("u")}, {part("v")} FROM (SELECT *, (ln((p + p2) / 2) - ln(p)) / (ln(p2) - ln(p)) AS s FROM (
        SELECT *, lead(p) OVER w AS p2, lead(u) OVER w AS u2, lead(v) OVER w AS v2 FROM {samples} WINDOW w AS (PARTITION BY cell ORDER BY p DESC)) WHERE p2 < p) GROUP BY cell"""


DEEP_SQL = LAYERS_SQL + f", top AS ({TOP_SQL.format(h=6000)}), smp AS (SELECT cell, p, u, v FROM pr WHERE agl < 6000 AND cell IN (SELECT cell FROM top) UNION ALL SELECT cell, p, u, v FROM top), pm AS ({_mean_over_pressure('smp')})"


@query("mean_wind_height", f"WITH {LAYERS_SQL}, m AS ({MEAN_SQL}) SELECT cell, round(u, 5) AS u, round(v, 5) AS v FROM (SELECT DISTINCT cell FROM pr) LEFT JOIN m USING (cell)")
def mean_wind_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column.mean_winds(soundings(spark, sf_dir), 6000.0).select("cell", F.round("u", 5).alias("u"), F.round("v", 5).alias("v"))


@query("mean_wind_pressure", f"WITH {DEEP_SQL} SELECT cell, round(u, 5) AS u, round(v, 5) AS v FROM (SELECT DISTINCT cell FROM pr) LEFT JOIN pm USING (cell)")
def mean_wind_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column.mean_winds(soundings(spark, sf_dir), 6000.0).select("cell", F.round("pu", 5).alias("u"), F.round("pv", 5).alias("v"))


@query(
    "pressure_shear",
    f"""WITH {LAYERS_SQL}, a AS (SELECT cell, CASE WHEN p = 600 THEN u ELSE u + (ln(p) - ln(600)) / (ln(p) - ln(p2)) * (u2 - u) END AS u, CASE WHEN p = 600 THEN v ELSE v + (ln(p) - ln(600)) / (ln(p) - ln(p2)) * (v2 - v) END AS v
        FROM ly WHERE p >= 600 AND (p2 < 600 OR p = 600)), b AS (SELECT cell, u AS u0, v AS v0 FROM pr WHERE k = 1)
    SELECT cell, round(sqrt((u - u0) * (u - u0) + (v - v0) * (v - v0)) * 1.943844, 5) AS shear_kt FROM b LEFT JOIN a USING (cell)""",
)
def pressure_shear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing where the profile doesn't span 600 hPa."""
    return column.pressure_shear(soundings(spark, sf_dir), 600.0).select("cell", F.round("shear_kt", 5).alias("shear_kt"))


CORFIDI_SQL = LAYERS_SQL + f""", n AS (SELECT cell, max(p) AS p0, least(850, max(p)) AS pb FROM pr GROUP BY cell HAVING count(*) >= 3),
    ends AS (SELECT cell, pb AS p FROM n UNION ALL SELECT cell, 300 FROM n),
    at_p AS (SELECT cell, e.p, CASE WHEN l.p = e.p THEN u ELSE u + (ln(e.p) - ln(l.p)) / (ln(p2) - ln(l.p)) * (u2 - u) END AS u, CASE WHEN l.p = e.p THEN v ELSE v + (ln(e.p) - ln(l.p)) / (ln(p2) - ln(l.p)) * (v2 - v) END AS v
        FROM ly l JOIN ends e USING (cell) WHERE l.p >= e.p AND (p2 < e.p OR l.p = e.p)),
    whole AS (SELECT cell FROM at_p GROUP BY cell HAVING count(*) = 2),
    deep_s AS (SELECT * FROM at_p WHERE cell IN (SELECT cell FROM whole) UNION ALL SELECT cell, p, u, v FROM pr JOIN n USING (cell) WHERE p < pb AND p > 300 AND cell IN (SELECT cell FROM whole)),
    top AS ({TOP_SQL.format(h=1500)}), low_s AS (SELECT cell, p, u, v FROM pr WHERE agl < 1500 AND cell IN (SELECT cell FROM top) UNION ALL SELECT cell, p, u, v FROM top),
    deep AS ({_mean_over_pressure('deep_s')}), low AS ({_mean_over_pressure('low_s')})"""


@query(
    "corfidi_motion",
    f"""WITH {CORFIDI_SQL} SELECT n.cell, round(d.u - l.u, 4) + 0.0 AS upshear_u, round(d.v - l.v, 4) + 0.0 AS upshear_v, round(d.u + (d.u - l.u), 4) + 0.0 AS downshear_u, round(d.v + (d.v - l.v), 4) + 0.0 AS downshear_v
    FROM n LEFT JOIN deep d ON d.cell = n.cell LEFT JOIN low l ON l.cell = n.cell""",
)
def corfidi_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing where the profile doesn't span the layers."""
    out = column.corfidi(soundings(spark, sf_dir))
    return out.select("cell", *[(F.round(c, 4) + 0.0).alias(c) for c in ("upshear_u", "upshear_v", "downshear_u", "downshear_v")])


@query(
    "bulk_shear",
    f"""WITH {LAYERS_SQL}, a AS ({AT_SQL.format(h=6000)}), b AS (SELECT cell, u AS u0, v AS v0 FROM pr WHERE k = 1)
    SELECT cell, round(sqrt((u - u0) * (u - u0) + (v - v0) * (v - v0)) * 1.943844, 5) AS shear_kt FROM a JOIN b USING (cell)""",
)
def bulk_shear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.bulk_shear(soundings(spark, sf_dir), 6000.0).select("cell", F.round("shear_kt", 5).alias("shear_kt"))


BUNKERS_SQL = DEEP_SQL + """, b AS (SELECT cell, u AS u0, v AS v0 FROM pr WHERE k = 1),
    s AS (SELECT cell, pm.u AS mu, pm.v AS mv, top.u - u0 AS su, top.v - v0 AS sv FROM pm JOIN top USING (cell) JOIN b USING (cell)),
    bk AS (SELECT cell, mu + 7.5 * sv / sqrt(su * su + sv * sv) AS ru, mv - 7.5 * su / sqrt(su * su + sv * sv) AS rv, mu - 7.5 * sv / sqrt(su * su + sv * sv) AS lu, mv + 7.5 * su / sqrt(su * su + sv * sv) AS lv FROM s WHERE sqrt(su * su + sv * sv) >= 1e-6)"""


@query("bunkers", f"WITH {BUNKERS_SQL} SELECT cell, round(ru, 4) AS right_u, round(rv, 4) AS right_v, round(lu, 4) AS left_u, round(lv, 4) AS left_v FROM (SELECT DISTINCT cell FROM pr) LEFT JOIN bk USING (cell)")
def bunkers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = column.storm_motions(soundings(spark, sf_dir))
    return out.select("cell", *[F.round(c, 4).alias(c) for c in ("right_u", "right_v", "left_u", "left_v")])


@query(
    "srh",
    f"""WITH {BUNKERS_SQL}, l AS (SELECT *, least(1.0, (3000 - agl) / (agl2 - agl)) AS s FROM ly WHERE agl < 3000 AND agl2 IS NOT NULL)
    SELECT cell, round(sum((u + s * (u2 - u) - ru) * (v - rv) - (u - ru) * (v + s * (v2 - v) - rv)), 3) AS srh FROM (SELECT DISTINCT cell FROM pr) LEFT JOIN l USING (cell) LEFT JOIN bk USING (cell) GROUP BY cell""",
)
def srh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column.storm_motions(soundings(spark, sf_dir)).select("cell", F.round("srh", 3).alias("srh"))


MOIST_SQL = SOUNDINGS_SQL + """, g0 AS (SELECT *, ln(least(100, greatest(1, rh)) / 100) + 17.625 * (t - 273.15) / (t - 273.15 + 243.04) AS gg FROM soundings WHERE rh > 0),
    mo AS (SELECT cell, p, z, t, least(t, 243.04 * gg / (17.625 - gg) + 273.15) AS td, row_number() OVER (PARTITION BY cell ORDER BY z) AS k, max(p) OVER (PARTITION BY cell) AS p0, min(p) OVER (PARTITION BY cell) AS p9, min(z) OVER (PARTITION BY cell) AS z0, count(*) OVER (PARTITION BY cell) AS n FROM g0),
    ml AS (SELECT *, lead(p) OVER w AS p2, lead(t) OVER w AS t2, lead(td) OVER w AS td2, lead(z) OVER w AS z2 FROM mo WINDOW w AS (PARTITION BY cell ORDER BY z))"""
W_SQL = "(0.622 * 6.112 * exp(17.67 * ({td} - 273.15) / ({td} - 273.15 + 243.5)) / ({p} - 6.112 * exp(17.67 * ({td} - 273.15) / ({td} - 273.15 + 243.5))))"


@query(
    "mixed_layer_parcel",
    f"""WITH {MOIST_SQL}, c AS (SELECT * FROM ml WHERE n >= 2 AND p0 > 200), e AS (SELECT cell, p0 - 100 AS p, CASE WHEN p = p0 - 100 THEN t ELSE t + (ln(p0 - 100) - ln(p)) / (ln(p2) - ln(p)) * (t2 - t) END AS t,
        CASE WHEN p = p0 - 100 THEN td ELSE td + (ln(p0 - 100) - ln(p)) / (ln(p2) - ln(p)) * (td2 - td) END AS td FROM c WHERE p >= p0 - 100 AND (p2 < p0 - 100 OR p = p0 - 100)),
    s AS (SELECT cell, p, t, td FROM e UNION ALL SELECT cell, p, t, td FROM c WHERE p > p0 - 100 AND cell IN (SELECT cell FROM e)),
    g AS (SELECT *, lead(p) OVER w AS p2, lead(t) OVER w AS t2, lead(td) OVER w AS td2 FROM s WINDOW w AS (PARTITION BY cell ORDER BY p DESC)),
    h AS (SELECT *, (p + p2) / 2 AS pm, (ln((p + p2) / 2) - ln(p)) / (ln(p2) - ln(p)) AS x FROM g WHERE p2 < p), m AS (SELECT *, t + (t2 - t) * x AS tm, td + (td2 - td) * x AS tdm FROM h),
    a AS (SELECT cell, max(p) AS p0, sum((t * pow(1000 / p, 0.2854) + 4 * tm * pow(1000 / pm, 0.2854) + t2 * pow(1000 / p2, 0.2854)) / 6 * (p - p2)) / sum(p - p2) AS theta,
        sum(({W_SQL.format(td="td", p="p")} + 4 * {W_SQL.format(td="tdm", p="pm")} + {W_SQL.format(td="td2", p="p2")}) / 6 * (p - p2)) / sum(p - p2) AS w FROM m GROUP BY cell),
    o AS (SELECT cell, p0, theta * pow(p0 / 1000, 0.2854) AS t, ln(w * p0 / (0.622 + w) / 6.112) AS x FROM a)
    SELECT b.cell, round(p0, 3) AS p, round(t, 4) AS t, round(243.5 * x / (17.67 - x) + 273.15, 4) AS td FROM (SELECT DISTINCT cell FROM c) b LEFT JOIN o USING (cell)""",
)
def mixed_layer_parcel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing where the profile is less than 100 hPa deep."""
    return column.mixed_layer(soundings(spark, sf_dir)).select("cell", F.round("p", 3).alias("p"), F.round("t", 4).alias("t"), F.round("td", 4).alias("td"))


@query(
    "most_unstable_source",
    f"""WITH {MOIST_SQL}, k AS (SELECT cell, z0, unnest(generate_series(0, CAST(floor((p0 - greatest(p9, p0 - 300)) / 10) AS INTEGER))) AS i, p0 FROM mo WHERE k = 1 AND n >= 2), q AS (SELECT cell, z0, i, p0 - 10 * i AS q FROM k),
    x AS (SELECT cell, z0, i, q, CASE WHEN p = q THEN 0 ELSE (ln(q) - ln(p)) / (ln(p2) - ln(p)) END AS s, l.* EXCLUDE (cell, z0) FROM q JOIN ml l USING (cell, z0) WHERE p >= q AND (p2 < q OR p = q)),
    y AS (SELECT cell, i, q, z + s * coalesce(z2 - z, 0) - z0 AS agl, t + s * coalesce(t2 - t, 0) AS t, td + s * coalesce(td2 - td, 0) AS td FROM x),
    v AS (SELECT *, 6.112 * exp(17.67 * (td - 273.15) / (td - 273.15 + 243.5)) AS e, 56 + 1 / (1 / (td - 56) + ln(t / td) / 800) AS tl FROM y WHERE agl <= 4000), w AS (SELECT *, 0.622 * e / (q - e) AS w FROM v),
    f AS (SELECT *, t * pow(1000 / (q - e), 0.2854 * (1 - 0.28 * w)) * exp((3376 / tl - 2.54) * w * (1 + 0.81 * w)) AS th FROM w)
    SELECT cell, round(max(th), 4) AS theta_e FROM f GROUP BY cell""",
)
def most_unstable_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 10 hPa."""
    return column.most_unstable(soundings(spark, sf_dir), step=10.0).select("cell", F.round("theta_e", 4).alias("theta_e"))


@query(
    "warmest_layer",
    f"""WITH {SOUNDINGS_SQL}, b AS (SELECT *, min(z) OVER (PARTITION BY cell) + 100 AS ground FROM soundings),
    w AS (SELECT cell, max(CASE WHEN z > ground THEN t WHEN k0 THEN t - 2 END) - 273.15 AS c FROM (SELECT *, z = ground - 100 AS k0 FROM b) WHERE p >= 500 GROUP BY cell HAVING c IS NOT NULL)
    SELECT cell, round(c, 5) AS warmest_c, round(greatest(3, least(50, CASE WHEN c > -2 THEN 12 + 2 * (-2 - c) ELSE 12 + (-2 - c) END)), 5) AS ratio FROM w""",
)
def warmest_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ground lies 100 m above the lowest level and is 2 K colder."""
    rows = soundings(spark, sf_dir)
    ground = rows.groupBy("cell").agg((F.min("z") + 100).alias("surface_z"), (F.min_by("t", "z") - 2).alias("surface_t"), F.max("p").alias("p0")).where("p0 >= 500").drop("p0")
    return profile.warmest_level(rows, ground).select("cell", F.round("warmest_c", 5).alias("warmest_c"), F.round("ratio", 5).alias("ratio"))


@query(
    "cobb_profile",
    f"""WITH {SOUNDINGS_SQL}, o AS (SELECT cell, p, z, t - 12 AS t, rh, (v - 6) * 0.05 AS om FROM soundings WHERE p BETWEEN 300 AND 925),
    w AS (SELECT *, t - 273.15 AS tc, -100 * (om / 9.8 / (p * 100 / (287.058 * t))) AS w FROM o), r AS ({COBB_SQL.format("w")}),
    g AS (SELECT *, CASE WHEN w >= 0 THEN CASE WHEN rh >= 80 THEN sqrt(w) ELSE sqrt(w) * (rh * rh / 6400) END END AS g FROM r),
    s AS (SELECT cell, sum(ratio * g) FILTER (g > 0 AND ratio IS NOT NULL AND z > 900) / sum(g) FILTER (g > 0 AND ratio IS NOT NULL AND z > 900) AS ratio FROM g GROUP BY cell)
    SELECT cell, round(CASE WHEN ratio > 0 AND ratio <= 50 THEN ratio END, 4) AS ratio FROM s""",
)
def cobb_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = soundings(spark, sf_dir).where(F.col("p").between(300, 925))
    rows = rows.select("cell", "p", "z", (F.col("t") - 12).alias("t"), "rh", ((F.col("v") - 6) * 0.05).alias("omega"))
    return profile.cobb_profile(rows, F.lit(900.0)).select("cell", F.round("ratio", 4).alias("ratio"))


@query(
    "lapse_rate_700_500",
    f"""WITH {LAYERS_SQL}, f AS (SELECT cell, max(t) FILTER (p = 700) AS t7, max(z) FILTER (p = 700) AS z7, max(t) FILTER (p = 500) AS t5, max(z) FILTER (p = 500) AS z5,
        max(CASE WHEN p > 700 AND p2 < 700 THEN t + (ln(p) - ln(700)) / (ln(p) - ln(p2)) * (t2 - t) END) AS ti7, max(CASE WHEN p > 700 AND p2 < 700 THEN z + (ln(p) - ln(700)) / (ln(p) - ln(p2)) * (z2 - z) END) AS zi7,
        max(CASE WHEN p > 500 AND p2 < 500 THEN t + (ln(p) - ln(500)) / (ln(p) - ln(p2)) * (t2 - t) END) AS ti5, max(CASE WHEN p > 500 AND p2 < 500 THEN z + (ln(p) - ln(500)) / (ln(p) - ln(p2)) * (z2 - z) END) AS zi5 FROM ly GROUP BY cell),
    g AS (SELECT cell, coalesce(t7, ti7) AS t7, coalesce(z7, zi7) AS z7, coalesce(t5, ti5) AS t5, coalesce(z5, zi5) AS z5 FROM f)
    SELECT cell, round(CASE WHEN z5 - z7 > 50 THEN (t7 - t5) / ((z5 - z7) / 1000) END, 5) AS lapse FROM g WHERE t7 IS NOT NULL AND t5 IS NOT NULL""",
)
def lapse_rate_700_500(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.lapse_rate_between(soundings(spark, sf_dir), 700.0, 500.0).select("cell", F.round("lapse", 5).alias("lapse"))


@query("parcel_indices")
def parcel_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iterative ascent and descent, which SQL can't express; golden profiles test it."""
    return parcel.parcel_indices(soundings(spark, sf_dir))


@query("stability_indices")
def stability_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifted, Showalter, wet-bulb zero, mixed-layer and most unstable parcels: iterative, tested by published properties."""
    rows = soundings(spark, sf_dir)
    return parcel.stability_indices(rows, column.mixed_layer(rows))


@query("effective_layer")
def effective_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parcel.effective_layers(soundings(spark, sf_dir))


@query("wet_bulb_at_pressure")
def wet_bulb_at_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normand's wet bulb by secant iteration."""
    return parcel.wet_bulbs(surface(spark, sf_dir)).select(*KEYS, "wet_bulb")


@query(
    "western_slr",
    f"""WITH {ITEMS_SQL} SELECT {KEY_SQL}, round(CASE WHEN -80 - q <= -103 AND e / 20 >= 1000 THEN 175.77922006647756 - 0.5658923009849022 * (250 + q) - 0.03800487156496504 * (245 + q) - 0.2584244800211978 * (x * 100) - 0.033285591001853895 * (y * 100) END, 6) AS ratio FROM items0""",
)
def western_slr(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    rows = items(spark, sf_dir).withColumns({"t_04k": 250 + q, "t_24k": 245 + q, "spd_04k": F.col("x") * 100, "spd_24k": F.col("y") * 100})
    return rows.select(*KEYS, F.round(forest.western_ratio(-80 - q, F.col("e") / 20), 6).alias("ratio"))


TOY_FOREST = [
    forest.Tree(*map(np.array, ([1, -1, 3, -1, -1], [2, -1, 4, -1, -1], [0, 0, 1, 0, 0], [25.0, 0, 0.05, 0, 0], [0, 8.0, 0, 12.0, 16.0]))),
    forest.Tree(*map(np.array, ([1, -1, -1], [2, -1, -1], [2, 0, 0], [0.04, 0, 0], [0, 10.0, 20.0]))),
]


@query(
    "rf_slr",
    f"""WITH {ITEMS_SQL}, v AS (SELECT *, CASE WHEN q <= 25 THEN 8.0 WHEN b % 6 <> 0 THEN CASE WHEN x <= 0.05 THEN 12.0 ELSE 16.0 END END AS t1, CASE WHEN y <= 0.04 THEN 10.0 ELSE 20.0 END AS t2 FROM items0)
    SELECT {KEY_SQL}, list_avg([t1, t2]) AS ratio FROM v""",
)
def rf_slr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of two small trees; a tree with a missing feature doesn't vote."""
    rows = items(spark, sf_dir).withColumn("xm", F.when(F.col("b") % 6 != 0, F.col("x")))
    return forest.forest_ratio(rows, TOY_FOREST, ["q", "xm", "y"]).select(*KEYS, "ratio")


FEATURE_HEIGHTS = [300.0 * k for k in range(1, 9)]


@query(
    "snow_ratio_features",
    f"""WITH {SOUNDINGS_SQL}, b AS (SELECT cell, p, z - min(z) OVER (PARTITION BY cell) AS agl, sqrt(u * u + v * v) AS spd, t, rh FROM soundings), l AS (SELECT *, lead(agl) OVER w AS agl2, lead(spd) OVER w AS spd2, lead(t) OVER w AS t2, lead(rh) OVER w AS rh2 FROM b WINDOW w AS (PARTITION BY cell ORDER BY agl)),
    h AS (SELECT unnest({FEATURE_HEIGHTS}) AS h), x AS (SELECT cell, h, (h - agl) / (agl2 - agl) AS s, spd, t, rh, spd2, t2, rh2 FROM l, h WHERE agl <= h AND agl2 > h)
    SELECT c.cell, h.h AS agl, round(spd + (spd2 - spd) * s, 4) AS spd, round(t + (t2 - t) * s, 4) AS t, round(rh + (rh2 - rh) * s, 4) AS rh FROM (SELECT DISTINCT cell FROM soundings) c CROSS JOIN h LEFT JOIN x ON x.cell = c.cell AND x.h = h.h""",
)
def snow_ratio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed, temperature and humidity at eight heights above the ground."""
    out = column.agl_values(soundings(spark, sf_dir), FEATURE_HEIGHTS)
    return out.select("cell", "agl", *[F.round(c, 4).alias(c) for c in ("spd", "t", "rh")])


@query("pressure_at_agl", f"WITH {LAYERS_SQL}, a AS ({TOP_SQL.format(h=3000)}) SELECT c.cell, round(p, 4) AS p FROM (SELECT DISTINCT cell FROM pr) c LEFT JOIN a USING (cell)")
def pressure_at_agl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = column.at_height(column.columns(soundings(spark, sf_dir)), "x", F.lit(3000.0))
    return rows.select("cell", F.round("x.p", 4).alias("p"))


@query(
    "levels_without_doubles",
    """WITH l AS (SELECT l_suppkey AS cell, 1000 - l_quantity * 15 + l_discount AS p, l_orderkey * 10 + l_linenumber AS ordinal FROM lineitem)
    SELECT cell, round(p, 4) AS p, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY cell, floor(p * 10 + 0.5) ORDER BY ordinal, p) AS k FROM l) WHERE k = 1""",
)
def levels_without_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = 1000 - F.col("l_quantity") * 15 + F.col("l_discount")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), p.alias("p"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return column.without_doubles(rows.withColumn("order", F.struct("ordinal", "p")), order="order").select("cell", F.round("p", 4).alias("p"), "ordinal")


@query(
    "ice_environment",
    f"""WITH {ITEMS_SQL}, s AS (SELECT {KEY_SQL}, 263 + q / 2 AS t, CASE WHEN b % 3 <> 0 THEN 255 + q / 3 END AS td, 40 + x * 500 AS rh, y * 200 AS u, q / 5 AS v FROM items0), g AS (SELECT *, ln(least(100, greatest(1, rh)) / 100) + 17.625 * (t - 273.15) / (t - 273.15 + 243.04) AS g FROM s),
    d AS (SELECT *, coalesce(td, 243.04 * g / (17.625 - g) + 273.15) AS dew FROM g), e AS (SELECT *, t - 273.15 AS cc, greatest(1, least(100, 100 * exp(17.67 * (dew - 273.15) / (dew - 273.15 + 243.5)) / exp(17.67 * (t - 273.15) / (t - 273.15 + 243.5)))) AS h FROM d)
    SELECT {KEY_SQL}, round(cc * atan(0.151977 * sqrt(h + 8.313659)) + atan(cc + h) - atan(h - 1.676331) + 0.00391838 * pow(h, 1.5) * atan(0.023101 * h) - 4.686035, 5) AS wet_bulb_c, round(sqrt(u * u + v * v) * 1.943844, 5) AS wind_kt FROM e""",
)
def ice_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    rows = items(spark, sf_dir).withColumns({"t": 263 + q / 2, "td": F.when(F.col("b") % 3 != 0, 255 + q / 3), "rh": 40 + F.col("x") * 500, "u": F.col("y") * 200, "v": q / 5})
    return _out(snow.ice_environment(rows), wet_bulb_c=F.col("wet_bulb_c"), wind_kt=F.col("wind_kt"))
