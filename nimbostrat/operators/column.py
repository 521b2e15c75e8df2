"""Wind and parcel diagnostics of whole columns, one array a cell.

A profile's levels, tens at most, are gathered once into an array from the lowest
level up; every diagnostic is then an expression over that array, so several of
them together cost one shuffle.  What a profile doesn't span is missing.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbostrat.functions import thermo
from nimbostrat.functions.units import MPS_TO_KT
from nimbostrat.operators import parcel

WINDS = ("u", "v")
_FRESH = itertools.count()


def fresh(name: str) -> str:
    return f"__{name}_{next(_FRESH)}"


def columns(profiles: DataFrame, names: tuple[str, ...] = WINDS, optional: tuple[str, ...] = ()) -> DataFrame:
    """cell, levels: structs of z, p, agl and ``names``, without levels that lack one of them; ``optional`` ones may be missing."""
    known = profiles
    for c in ("z", "p", *names):
        known = known.where(F.col(c).isNotNull())
    names = (*names, *optional)
    rows = known.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("z", (-F.col("p")).alias("order"), "p", *names))).alias("rows"))
    base = F.col("rows")[0]["z"]
    return rows.select("cell", F.transform("rows", lambda x: F.struct(x["z"].alias("z"), x["p"].alias("p"), (x["z"] - base).alias("agl"), *[x[c].alias(c) for c in names])).alias("levels"))


def _between(rows: DataFrame, name: str, low: Column, high: Column, share: Column, p: Column, names: tuple[str, ...]) -> DataFrame:
    """``rows`` with a struct of p and ``names`` between two levels; each step is a column, so nothing is evaluated twice."""
    lo, hi, part = fresh("low"), fresh("high"), fresh("share")
    rows = rows.withColumns({lo: low, hi: high})
    rows = rows.withColumn(part, F.when(F.col(lo).isNotNull() & F.col(hi).isNotNull(), F.coalesce(share(F.col(lo), F.col(hi)), F.lit(0.0))))
    linear = lambda c: F.col(f"{lo}.{c}") + (F.col(f"{hi}.{c}") - F.col(f"{lo}.{c}")) * F.col(part)
    return rows.withColumn(name, F.when(F.col(part).isNotNull(), F.struct(p(F.col(lo), F.col(hi), F.col(part)).alias("p"), *[linear(c).alias(c) for c in names]))).drop(lo, hi, part)


def at_height(rows: DataFrame, name: str, height: Column, names: tuple[str, ...] = WINDS) -> DataFrame:
    """``rows`` with a struct of p and ``names`` at a height above the lowest level: p by its logarithm, the rest linear."""
    low = F.try_element_at(F.filter("levels", lambda x: x["agl"] <= height), F.lit(-1))
    high = F.try_element_at(F.filter("levels", lambda x: x["agl"] >= height), F.lit(1))
    p = lambda lo, hi, part: F.when(part == 0, lo["p"]).otherwise(F.exp(F.ln(lo["p"]) + (F.ln(hi["p"]) - F.ln(lo["p"])) * part))
    return _between(rows, name, low, high, lambda lo, hi: F.try_divide(height - lo["agl"], hi["agl"] - lo["agl"]), p, names)


def at_pressure(rows: DataFrame, name: str, pressure: Column, names: tuple[str, ...] = WINDS) -> DataFrame:
    """``rows`` with a struct of p and ``names`` at a pressure, linear in its logarithm."""
    low = F.try_element_at(F.filter("levels", lambda x: x["p"] >= pressure), F.lit(-1))
    high = F.try_element_at(F.filter("levels", lambda x: x["p"] <= pressure), F.lit(1))
    share = lambda lo, hi: F.try_divide(F.ln(pressure) - F.ln(lo["p"]), F.ln(hi["p"]) - F.ln(lo["p"]))
    return _between(rows, name, low, high, share, lambda lo, hi, part: pressure, names)


def pressure_mean(levels: Column, bottom: Column, top: Column, names: tuple[str, ...] = WINDS, weighted: bool = False) -> Column:
    """Mean over pressure between two structs of p and ``names``, by Simpson's rule.

    Within a segment values are linear in the logarithm of pressure, so its
    middle differs from the mean of its ends. weighted: each value counts by its pressure.
    """
    weight = (lambda p: p) if weighted else (lambda p: F.lit(1.0))
    inner = F.filter(levels, lambda x: (x["p"] < bottom["p"]) & (x["p"] > top["p"]))
    pick = lambda x: F.struct(x["p"].alias("p"), *[x[c].alias(c) for c in names])
    samples = F.concat(F.array(pick(bottom)), F.transform(inner, pick), F.array(pick(top)))
    start = F.struct(F.lit(0.0).alias("w"), pick(bottom).alias("last"), *[F.lit(0.0).alias(c) for c in names])

    def add(acc: Column, x: Column) -> Column:
        last = acc["last"]
        dp, middle = last["p"] - x["p"], (last["p"] + x["p"]) / 2
        share = F.coalesce(F.try_divide(F.ln(middle) - F.ln(last["p"]), F.ln(x["p"]) - F.ln(last["p"])), F.lit(0.0))
        lower, mid, upper = weight(last["p"]), weight(middle), weight(x["p"])
        part = lambda c: (lower * last[c] + 4 * mid * (last[c] + (x[c] - last[c]) * share) + upper * x[c]) / 6 * dp
        return F.struct((acc["w"] + (lower + 4 * mid + upper) / 6 * dp).alias("w"), x.alias("last"), *[(acc[c] + part(c)).alias(c) for c in names])

    mean = F.aggregate(samples, start, add, lambda acc: F.struct(*[F.try_divide(acc[c], acc["w"]).alias(c) for c in names]))
    return F.when(bottom.isNotNull() & top.isNotNull() & (bottom["p"] > top["p"]), mean)


def height_mean(levels: Column, top: Column, names: tuple[str, ...] = WINDS) -> Column:
    """Mean over height from the lowest level to a struct of agl and ``names``, by trapezoids."""
    inner = F.filter(levels, lambda x: x["agl"] < top["agl"])
    start = F.struct(inner[0]["agl"].alias("agl"), F.lit(0.0).alias("w"), *[inner[0][c].alias(f"last_{c}") for c in names], *[F.lit(0.0).alias(c) for c in names])
    steps = F.concat(F.transform(inner, lambda x: F.struct(x["agl"].alias("agl"), *[x[c].alias(c) for c in names])), F.array(F.struct(top["agl"].alias("agl"), *[top[c].alias(c) for c in names])))

    def add(acc: Column, x: Column) -> Column:
        dz = x["agl"] - acc["agl"]
        return F.struct(x["agl"].alias("agl"), (acc["w"] + dz).alias("w"), *[x[c].alias(f"last_{c}") for c in names], *[(acc[c] + (acc[f"last_{c}"] + x[c]) / 2 * dz).alias(c) for c in names])

    mean = F.aggregate(steps, start, add, lambda acc: F.struct(*[F.try_divide(acc[c], acc["w"]).alias(c) for c in names]))
    return F.when(top.isNotNull(), mean)


def _lowest(names: tuple[str, ...] = WINDS) -> Column:
    first = F.col("levels")[0]
    return F.struct(first["p"].alias("p"), *[first[c].alias(c) for c in names])


def mean_winds(profiles: DataFrame, top: float) -> DataFrame:
    """cell, u, v (mean over height) and pu, pv (mean over pressure) up to a height; missing where the profile ends below."""
    rows = at_height(columns(profiles), "high", F.lit(top)).withColumn("base", _lowest())
    end = F.when(F.col("high").isNotNull(), F.struct(F.lit(top).alias("agl"), F.col("high.u").alias("u"), F.col("high.v").alias("v")))
    rows = rows.withColumn("end", end).withColumns({"h": height_mean(F.col("levels"), F.col("end")), "m": pressure_mean(F.col("levels"), F.col("base"), F.col("high"))})
    return rows.select("cell", "h.u", "h.v", F.col("m.u").alias("pu"), F.col("m.v").alias("pv"))


def storm_motions(profiles: DataFrame, top: float = 6000.0, deviation: float = 7.5, helicity_top: float = 3000.0) -> DataFrame:
    """cell, right_u, right_v, left_u, left_v, srh of columns.

    The motion is the mean wind over pressure up to ``top`` and a part across the
    shear between the lowest level and ``top``; srh is that of the right-mover up
    to ``helicity_top``.
    """
    rows = at_height(columns(profiles), "high", F.lit(top)).withColumn("base", _lowest())
    rows = at_height(rows, "end", F.lit(helicity_top)).withColumn("mean", pressure_mean(F.col("levels"), F.col("base"), F.col("high")))
    rows = rows.withColumns({"su": F.col("high.u") - F.col("base.u"), "sv": F.col("high.v") - F.col("base.v")})
    rows = rows.withColumn("size", F.sqrt(F.col("su") * F.col("su") + F.col("sv") * F.col("sv"))).withColumn("per", F.when(F.col("size") >= 1e-6, deviation / F.col("size")))
    u, v, across_u, across_v = F.col("mean.u"), F.col("mean.v"), F.col("per") * F.col("sv"), -F.col("per") * F.col("su")
    rows = rows.withColumns({"right_u": u + across_u, "right_v": v + across_v, "left_u": u - across_u, "left_v": v - across_v})
    return rows.withColumn("srh", helicity(F.col("levels"), F.lit(helicity_top), F.col("end"), F.col("right_u"), F.col("right_v"))).select("cell", "right_u", "right_v", "left_u", "left_v", "srh")


def helicity(levels: Column, top: Column, end: Column, c_u: Column, c_v: Column) -> Column:
    """m2/s2 from the lowest level to a height, where the wind is ``end``, relative to a motion.

    The motion's part depends only on the winds at both ends, so the sum over the
    levels is taken without it.
    """
    wind = lambda x: F.struct(x["u"].alias("u"), x["v"].alias("v"))
    winds = F.concat(F.transform(F.filter(levels, lambda x: x["agl"] < top), wind), F.array(wind(end)))
    start = F.struct(F.lit(0.0).alias("sum"), levels[0]["u"].alias("u"), levels[0]["v"].alias("v"))
    turn = lambda acc, x: x["u"] * acc["v"] - acc["u"] * x["v"]
    total = F.aggregate(winds, start, lambda acc, x: F.struct((acc["sum"] + turn(acc, x)).alias("sum"), x["u"].alias("u"), x["v"].alias("v")), lambda acc: acc["sum"])
    return F.when(end.isNotNull(), total + c_v * (levels[0]["u"] - end["u"]) + c_u * (end["v"] - levels[0]["v"]))


def helicity_between(levels: Column, low: Column, bottom: Column, high: Column, top: Column, c_u: Column, c_v: Column) -> Column:
    """m2/s2 between two heights that may differ by cell, where the winds are ``bottom`` and ``top``, relative to a motion."""
    wind = lambda x: F.struct(x["u"].alias("u"), x["v"].alias("v"))
    winds = F.concat(F.transform(F.filter(levels, lambda x: (x["agl"] > low) & (x["agl"] < high)), wind), F.array(wind(top)))
    start = F.struct(F.lit(0.0).alias("sum"), bottom["u"].alias("u"), bottom["v"].alias("v"))
    turn = lambda acc, x: x["u"] * acc["v"] - acc["u"] * x["v"]
    total = F.aggregate(winds, start, lambda acc, x: F.struct((acc["sum"] + turn(acc, x)).alias("sum"), x["u"].alias("u"), x["v"].alias("v")), lambda acc: acc["sum"])
    return F.when(bottom.isNotNull() & top.isNotNull() & (high > low), total + c_v * (bottom["u"] - top["u"]) + c_u * (top["v"] - bottom["v"]))


def corfidi(profiles: DataFrame) -> DataFrame:
    """cell, upshear_u, upshear_v, downshear_u, downshear_v: propagation of convective systems.

    The deep mean is from 850 hPa, or the lowest level where that is higher up, to
    300 hPa; the low mean from the lowest level to 1.5 km. At least three levels.
    """
    levels = F.col("levels")
    rows = columns(profiles).where(F.size("levels") >= 3).withColumn("base", _lowest()).withColumn("from_p", F.least(F.lit(850.0), F.col("base.p")))
    rows = at_height(at_pressure(at_pressure(rows, "bottom", F.col("from_p")), "top", F.lit(300.0)), "low_top", F.lit(1500.0))
    rows = rows.withColumns({"deep": pressure_mean(levels, F.col("bottom"), F.col("top")), "low": pressure_mean(levels, F.col("base"), F.col("low_top"))})
    up = lambda c: F.col(f"deep.{c}") - F.col(f"low.{c}")
    return rows.select("cell", up("u").alias("upshear_u"), up("v").alias("upshear_v"), (F.col("deep.u") + up("u")).alias("downshear_u"), (F.col("deep.v") + up("v")).alias("downshear_v"))


def pressure_shear(profiles: DataFrame, pressure: float) -> DataFrame:
    """cell, shear_kt between the lowest level and a pressure."""
    rows = at_pressure(columns(profiles), "high", F.lit(pressure))
    du, dv = F.col("high.u") - F.col("levels")[0]["u"], F.col("high.v") - F.col("levels")[0]["v"]
    return rows.select("cell", (F.sqrt(du * du + dv * dv) * MPS_TO_KT).alias("shear_kt"))


def _moist(profiles: DataFrame) -> DataFrame:
    """Levels with t, td (not above t), potential temperature and mixing ratio."""
    td = F.least(thermo.dewpoint_from_rh(F.col("t"), F.col("rh")), F.col("t"))
    rows = profiles.withColumn("td", td)
    return rows.withColumns({"theta": F.col("t") * F.pow(1000.0 / F.col("p"), F.lit(thermo.KAPPA)), "w": thermo.mixing_ratio(thermo.vapour_pressure(F.col("td")), F.col("p"))})


def mixed_layer(profiles: DataFrame, depth: float = 100.0) -> DataFrame:
    """cell, p, t, td: the parcel of the lowest ``depth`` hPa, its mean potential temperature and mixing ratio.

    Simpson's rule over pressure; the middle of a segment takes t and td linear in
    the logarithm of pressure. Missing where the profile is less deep.
    """
    rows = columns(_moist(profiles), ("t", "td")).where((F.size("levels") >= 2) & (F.col("levels")[0]["p"] > depth + 100))
    return mixed_parcels(rows, depth).select("cell", "mixed.*")


def mixed_parcels(rows: DataFrame, depth: float = 100.0) -> DataFrame:
    """``rows`` (cell, levels with t and td) with a struct ``mixed`` of p, t and td; other columns pass through."""
    levels, names = F.col("levels"), ("t", "td")
    given = rows.columns
    rows = at_pressure(rows.withColumn("p0", levels[0]["p"]), "high", F.col("p0") - depth, names)
    of = lambda x: F.struct(x["p"].alias("p"), x["t"].alias("t"), x["td"].alias("td"))
    inner = F.filter(levels, lambda x: (x["p"] < levels[0]["p"]) & (x["p"] > F.col("high.p")))
    samples = F.concat(F.array(of(levels[0])), F.transform(inner, of), F.array(of(F.col("high"))))
    theta = lambda t, p: t * F.pow(1000.0 / p, F.lit(thermo.KAPPA))
    ratio = lambda td, p: thermo.mixing_ratio(thermo.vapour_pressure(td), p)

    def add(acc: Column, x: Column) -> Column:
        last = acc["last"]
        dp, p = last["p"] - x["p"], (last["p"] + x["p"]) / 2
        share = F.coalesce(F.try_divide(F.ln(p) - F.ln(last["p"]), F.ln(x["p"]) - F.ln(last["p"])), F.lit(0.0))
        t, td = last["t"] + (x["t"] - last["t"]) * share, last["td"] + (x["td"] - last["td"]) * share
        a = (theta(last["t"], last["p"]) + 4 * theta(t, p) + theta(x["t"], x["p"])) / 6 * dp
        b = (ratio(last["td"], last["p"]) + 4 * ratio(td, p) + ratio(x["td"], x["p"])) / 6 * dp
        return F.struct((acc["n"] + dp).alias("n"), (acc["a"] + a).alias("a"), (acc["b"] + b).alias("b"), x.alias("last"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), of(levels[0]).alias("last"))
    rows = rows.withColumn("mean", F.when(F.col("high").isNotNull(), F.aggregate(samples, start, add, lambda acc: F.struct((acc["a"] / acc["n"]).alias("theta"), (acc["b"] / acc["n"]).alias("w")))))
    p = levels[0]["p"]
    t = F.col("mean.theta") * F.pow(p / 1000.0, F.lit(thermo.KAPPA))
    e = F.col("mean.w") * p / (thermo.EPSILON + F.col("mean.w"))
    return rows.select(*given, F.struct(F.when(F.col("mean").isNotNull(), p).alias("p"), t.alias("t"), thermo.dewpoint_from_vapour_pressure(e).alias("td")).alias("mixed"))


def most_unstable(profiles: DataFrame, depth: float = 300.0, highest: float = 4000.0, step: float = 1.0) -> DataFrame:
    """cell, p, agl, theta_e: of the levels every ``step`` hPa within ``depth`` of the lowest one, that of most theta-e; the lowest among equals."""
    rows = columns(_moist(profiles), ("t", "td")).where(F.size("levels") >= 2).select("cell", *[F.col("levels").getField(c).alias(c) for c in ("p", "z", "t", "td")])

    def found(p: np.ndarray, z: np.ndarray, t: np.ndarray, td: np.ndarray) -> dict[str, np.ndarray]:
        steps = p[:, :1] - step * np.arange(int(depth // step) + 1)
        agl, warm, dew = parcel.thermo_at(p, z - z[:, :1], t, td, steps)
        theta = np.where((agl <= highest) & (steps > 100), parcel.equivalent(warm, dew, steps), np.nan)
        known, each = np.isfinite(theta), np.arange(len(p))
        best = np.where(known, theta, -np.inf).argmax(axis=1)
        return {k: np.where(known.any(axis=1), v[each, best], np.nan) for k, v in (("p", steps), ("agl", agl), ("theta_e", theta))}

    out = parcel.by_column(rows, found, 2048, "p double, agl double, theta_e double")
    return out.select("cell", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("p", "agl", "theta_e")])


def without_doubles(levels: DataFrame, keys: tuple[str, ...] = ("cell",), order: str = "ordinal") -> DataFrame:
    """The first level of each tenth of a hectopascal, by ``order``."""
    tenth = F.floor(F.col("p") * 10 + 0.5)
    rest = [c for c in levels.columns if c not in keys]
    return levels.groupBy(*keys, tenth.alias("tenth")).agg(F.min_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def agl_values(profiles: DataFrame, heights: list[float], names: tuple[str, ...] = ("spd", "t", "rh")) -> DataFrame:
    """cell, agl and ``names`` at each of several heights above the lowest level; missing above the profile.

    spd is the speed of u and v. These are the inputs of fitted snow ratios.
    """
    rows = columns(profiles.withColumn("spd", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))), names)
    rows = rows.select("cell", "levels", F.explode(F.array(*[F.lit(float(h)) for h in heights])).alias("agl"))
    return at_height(rows, "x", F.col("agl"), names).select("cell", "agl", *[F.col(f"x.{c}").alias(c) for c in names])


def agl_features(profiles: DataFrame, heights: list[float], names: tuple[str, ...] = ("spd", "t", "rh")) -> DataFrame:
    """cell and an array: all heights' values of each name in turn; missing unless all are known."""
    rows = agl_values(profiles, heights, names)
    by_height = F.sort_array(F.collect_list(F.struct("agl", *names)))
    whole = rows.groupBy("cell").agg(by_height.alias("x"))
    features = F.concat(*[F.col("x").getField(c) for c in names])
    return whole.select("cell", F.when(~F.exists(features, lambda v: v.isNull()), features).alias("features"))
