"""Two integrators of parcel ascent, and the paths of parcels.

The segment integrator takes one step a layer between levels; the pressure
integrator samples buoyancy every hectopascal, at every level and at condensation.
Both work on a batch of cells at once: matrices of cells by levels, ordered from
the lowest level up, with gaps as NaN. Heights are above the lowest level.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbostrat.functions.thermo import DRY_LAPSE, GRAVITY, KAPPA
from nimbostrat.operators.parcel import arrays, by_column, equivalent, lcl_temperature, mixing_ratio, moist_lift, moist_move, vapour_pressure, virtual

#: Cells of which the matrices are held at once.
TOGETHER = 512
RESULTS = ("cape", "cin", "lcl_m", "lfc_m", "el_m")
#: hPa above which negative buoyancy is no inhibition any more.
CIN_TOP = 500.0


class Source:
    """Parcels at their start, and where they condense; missing where too dry, too high or too far from physical."""

    def __init__(self, p: np.ndarray, agl: np.ndarray, t: np.ndarray, td: np.ndarray):
        self.p, self.agl, self.t = p, agl, t
        dew = np.minimum(td, t)
        good = np.isfinite(p) & np.isfinite(agl) & np.isfinite(t) & np.isfinite(td) & (p > 100) & (td <= t + 0.5)
        self.lcl_t = np.where(good, lcl_temperature(t, dew), np.nan)
        self.lcl_p = p * (self.lcl_t / t) ** (1 / KAPPA)
        self.lcl_agl = agl + np.maximum(0, t - self.lcl_t) / DRY_LAPSE
        self.w = mixing_ratio(vapour_pressure(dew), p)
        self.good = good & np.isfinite(self.lcl_p) & np.isfinite(self.w)


def segments(p: np.ndarray, agl: np.ndarray, t: np.ndarray, td: np.ndarray, source: Source) -> dict[str, np.ndarray]:
    """cape, cin, lcl_m, lfc_m and el_m by one step a layer, at its mean pressure, temperature and dewpoint.

    Positive layers at or above condensation are CAPE; negative ones before the first of
    them are CIN. The level of free convection is where buoyancy crosses zero below that first layer,
    the equilibrium level the top of the last one or the crossing above it.
    """
    n = len(p)
    cape, cin, lfc, el = np.zeros(n), np.zeros(n), np.full(n, np.nan), np.full(n, np.nan)
    positive, before, at = np.zeros(n, bool), np.full(n, np.nan), source.agl.copy()
    parcel, parcel_at = source.lcl_t.copy(), source.lcl_agl.copy()
    for k in range(p.shape[1] - 1):
        dz = agl[:, k + 1] - agl[:, k]
        mid_p, mid = np.exp((np.log(p[:, k]) + np.log(p[:, k + 1])) / 2), (agl[:, k] + agl[:, k + 1]) / 2
        env_t, env_td = (t[:, k] + t[:, k + 1]) / 2, (td[:, k] + td[:, k + 1]) / 2
        env = virtual(env_t, mixing_ratio(vapour_pressure(env_td), mid_p))
        here = source.good & (dz > 1) & np.isfinite(env) & (mid > source.agl + 1) & (mid_p <= source.p + 1)
        if not here.any():
            continue
        below = mid_p >= source.lcl_p
        dry = below | (mid <= source.lcl_agl)
        wet = moist_move(parcel, parcel_at, np.where(here & ~dry, mid, parcel_at), mid_p)
        lifted = np.where(dry, source.t * (mid_p / source.p) ** KAPPA, wet)
        moved = here & ~dry & np.isfinite(wet)
        parcel, parcel_at = np.where(moved, wet, parcel), np.where(moved, mid, parcel_at)
        tv = virtual(lifted, np.where(below, source.w, mixing_ratio(vapour_pressure(lifted), mid_p)))
        force = GRAVITY * (tv - env) / np.maximum(180.0, env)
        here &= np.isfinite(force)
        work = force * dz
        up = here & (work > 0) & ((mid >= source.lcl_agl - 1) | (mid_p <= source.lcl_p + 0.1))
        first = up & ~positive
        share = np.clip(-before / np.maximum(1e-9, force - before), 0, 1)
        cross = np.where(before <= 0, at + (mid - at) * share, np.where(at < source.lcl_agl, source.lcl_agl, mid))
        lfc = np.where(first, np.maximum(source.lcl_agl, cross), lfc)
        cape += np.where(up, work, 0.0)
        down = here & ~up & ~positive & (work < 0)
        cin += np.where(down, work, 0.0)
        falls = here & ~up & ~down & (before > 0) & (force <= 0)
        share = np.clip(before / np.maximum(1e-9, before - force), 0, 1)
        el = np.where(up, agl[:, k + 1], np.where(falls, at + (mid - at) * share, el))
        positive |= up
        before, at = np.where(here, force, before), np.where(here, mid, at)
    out = {"cape": cape, "cin": np.minimum(cin, 0), "lcl_m": source.lcl_agl, "lfc_m": lfc, "el_m": el}
    return {k: np.where(source.good, v, np.nan) for k, v in out.items()}


def along_pressure(p: np.ndarray, values: list[np.ndarray], target: np.ndarray) -> list[np.ndarray]:
    """Each row's values at its target pressures, linear in the logarithm; missing outside and where gaps leave nothing."""
    out = [np.full(target.shape, np.nan) for _ in values]
    for r in range(len(p)):
        known = np.isfinite(p[r]) & np.all([np.isfinite(v[r]) for v in values], axis=0)
        if known.sum() < 1:
            continue
        x, want = -np.log(p[r, known]), -np.log(target[r])
        # judged by pressure: two logarithms of one number may differ in their last bit
        inside = (target[r] <= p[r, known].max()) & (target[r] >= p[r, known].min())
        for v, found in zip(values, out, strict=True):
            found[r] = np.where(inside, np.interp(want, x, v[r, known]), np.nan)
    return out


def sample_pressures(p: np.ndarray, source: Source, step: float = 1.0) -> np.ndarray:
    """For each row, from high to low: its source, its condensation, its levels and every whole step between; padded with NaN."""
    top = np.nanmin(p, axis=1)
    start = np.floor(source.p / step) * step
    count = int(np.nanmax(np.where(source.good & (start >= top), (start - top) // step, 0), initial=0)) + 1
    whole = start[:, None] - step * np.arange(count)
    every = np.concatenate([source.p[:, None], top[:, None], source.lcl_p[:, None], p, whole], axis=1)
    every = np.where((every <= source.p[:, None] + 1e-6) & (every >= top[:, None] - 1e-6) & source.good[:, None], every, np.nan)
    every = -np.sort(-every, axis=1)
    every[:, 1:][np.diff(every, axis=1) > -1e-6] = np.nan
    every = -np.sort(-every, axis=1)
    return every[:, : max(int(np.isfinite(every).sum(axis=1).max(initial=0)), 1)]


def path(source: Source, at: np.ndarray, step: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Temperature and virtual temperature of each parcel at pressures (rows, n): dry, then saturated.

    Parcels of one start share their saturated path at whole steps of pressure.
    """
    p, t, lcl_p, lcl_t, w = (x[:, None] for x in (source.p, source.t, source.lcl_p, source.lcl_t, source.w))
    dry = at >= lcl_p
    temperature = t * (at / p) ** KAPPA
    _, first, of = np.unique(np.stack([source.lcl_p, source.lcl_t], axis=1), axis=0, return_index=True, return_inverse=True)
    moist = ~dry & np.isfinite(at)
    place = at / step
    whole = moist & (place == np.floor(place))
    if whole.any():
        place, of = np.where(whole, place, 0).astype(np.int64), of.reshape(-1, 1)
        low = place[whole].min()
        asked = np.zeros((len(first), int(place.max() - low) + 1), bool)
        asked[np.broadcast_to(of, at.shape)[whole], place[whole] - low] = True
        table, (rows, cols) = np.full(asked.shape, np.nan), np.nonzero(asked)
        table[rows, cols] = moist_lift(source.lcl_p[first[rows]], source.lcl_t[first[rows]], (cols + low) * step)
        temperature = np.where(whole, table[of, np.maximum(place - low, 0)], temperature)
    rows, cols = np.nonzero(moist & ~whole)
    temperature[rows, cols] = moist_lift(source.lcl_p[rows], source.lcl_t[rows], at[rows, cols])
    ratio = np.where(dry, w, mixing_ratio(vapour_pressure(temperature), at))
    return np.where(source.good[:, None], temperature, np.nan), np.where(source.good[:, None], virtual(temperature, ratio), np.nan)


def pressure_steps(p: np.ndarray, agl: np.ndarray, t: np.ndarray, td: np.ndarray, source: Source, step: float = 1.0) -> dict[str, np.ndarray]:
    """cape, cin, lcl_m, lfc_m, el_m and cape_3km by trapezoids of buoyancy between samples of pressure.

    CIN counts up to 500 hPa and before the first positive interval at or above
    condensation. The equilibrium level is the last crossing from positive buoyancy.
    """
    at = sample_pressures(p, source, step)
    height, warm, dew = along_pressure(p, [agl, t, td], at)
    lcl_m = along_pressure(p, [agl], source.lcl_p[:, None])[0][:, 0]
    lcl_m = np.where(np.isfinite(lcl_m), np.maximum(0, lcl_m), np.maximum(0, source.lcl_agl))
    env = virtual(warm, mixing_ratio(vapour_pressure(np.minimum(dew, warm)), at))
    _, tv = path(source, at, step)
    force = GRAVITY * (tv - env) / np.maximum(180.0, env)
    low, high, z0, z1 = force[:, :-1], force[:, 1:], height[:, :-1], height[:, 1:]
    dz = z1 - z0
    with np.errstate(all="ignore"):
        known = np.isfinite(low) & np.isfinite(high) & (dz > 0)
        work = np.where(known, (low + high) / 2 * dz, 0.0)
        up = (work > 0) & ((at[:, 1:] <= source.lcl_p[:, None] + 1e-6) | (z1 >= lcl_m[:, None] - 1))
        seen = np.logical_or.accumulate(up, axis=1) if up.shape[1] else up
        cross = np.where(np.abs(high - low) > 1e-9, z0 + dz * np.clip(-low / (high - low), 0, 1), lcl_m[:, None])
        part = np.clip((3000.0 - z0) / dz, 0, 1)
        clipped = np.where(z1 <= 3000, work, np.maximum(0, (low + (low + (high - low) * part)) / 2 * (3000.0 - z0)))
        ends = seen & known & (low > 0) & (high <= 0)
    n, rows = len(p), np.arange(len(p))
    pick = lambda mask, k: np.where(mask.any(axis=1), cross[rows, k], np.nan) if mask.shape[1] else np.full(n, np.nan)
    first = up.argmax(axis=1) if up.shape[1] else rows * 0
    last = up.shape[1] - 1 - ends[:, ::-1].argmax(axis=1) if up.shape[1] else rows * 0
    inhibits = (work < 0) & ~seen & (at[:, 1:] >= CIN_TOP)
    out = {
        "cape": np.where(up, work, 0.0).sum(axis=1), "cin": np.where(inhibits, work, 0.0).sum(axis=1), "lcl_m": lcl_m, "lfc_m": np.maximum(lcl_m, pick(up, first)), "el_m": pick(ends, last),
        "cape_3km": np.where(up & (z0 < 3000), clipped, 0.0).sum(axis=1),
    }
    return {k: np.where(source.good, v, np.nan) for k, v in out.items()}


def saturated_temperature(theta_e: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Temperature at p of saturated air of an equivalent potential temperature, by bisection of a monotone function."""
    low, high = np.full(np.broadcast(theta_e, p).shape, 130.0), np.full(np.broadcast(theta_e, p).shape, 340.0)
    for _ in range(60):
        middle = (low + high) / 2
        with np.errstate(all="ignore"):
            warm = equivalent(middle, middle, p) > theta_e
        warm |= vapour_pressure(middle) >= p
        low, high = np.where(warm, low, middle), np.where(warm, middle, high)
    return (low + high) / 2


def _known(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("cell", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names])


def both_integrators(profiles: DataFrame, step: float = 1.0) -> DataFrame:
    """cell and the lowest level's parcel by both integrators: names ending in _seg and _step, and cape_3km.

    Cells of fewer than three complete levels are missing.
    """
    names = [f"{c}_{kind}" for kind in ("seg", "step") for c in RESULTS] + ["cape_3km"]

    def found(p: np.ndarray, z: np.ndarray, t: np.ndarray, td: np.ndarray) -> dict[str, np.ndarray]:
        agl = z - z[:, :1]
        source = Source(p[:, 0], agl[:, 0], t[:, 0], td[:, 0])
        source.good &= np.isfinite(p).sum(axis=1) >= 3
        a, b = segments(p, agl, t, td, source), pressure_steps(p, agl, t, td, source, step)
        return {**{f"{c}_seg": a[c] for c in RESULTS}, **{f"{c}_step": b[c] for c in RESULTS}, "cape_3km": b["cape_3km"]}

    return _known(by_column(arrays(profiles), found, TOGETHER, ", ".join(f"{c} double" for c in names)), names)


def parcel_traces(profiles: DataFrame, step: float = 25.0) -> DataFrame:
    """cell, p, t, tv, dewpoint, env_tv as arrays: the path of the lowest level's parcel.

    The path has the parcel's start, its condensation, the levels and every whole
    ``step`` of pressure up to the highest level. The dewpoint follows the mixing
    ratio up to condensation, and is the temperature from there on.
    """
    names = ("p", "t", "tv", "dewpoint", "env_tv")

    def found(p: np.ndarray, z: np.ndarray, t: np.ndarray, td: np.ndarray) -> dict[str, pa.Array]:
        source = Source(p[:, 0], np.zeros(len(p)), t[:, 0], td[:, 0])
        at = sample_pressures(p, source, step)
        temperature, tv = path(source, at, step)
        x = np.log(source.w[:, None] * at / (0.622 + source.w[:, None]) / 6.112)
        dew = np.where(at >= source.lcl_p[:, None], 243.5 * x / (17.67 - x) + 273.15, temperature)
        warm, moist = along_pressure(p, [t, td], at)
        env = virtual(warm, mixing_ratio(vapour_pressure(np.minimum(moist, warm)), at))
        kept = np.isfinite(at) & np.isfinite(tv)
        offsets = pa.array(np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype(np.int32))
        return {c: pa.ListArray.from_arrays(offsets, pa.array(m[kept])) for c, m in zip(names, (at, temperature, tv, dew, env), strict=True)}

    return by_column(arrays(profiles), found, TOGETHER, ", ".join(f"{c} array<double>" for c in names))


def moist_adiabats(levels: DataFrame, theta_e: Column, pressure: Column) -> DataFrame:
    """``levels`` with ``adiabat``: the temperature of saturated air of theta_e at a pressure."""

    @F.pandas_udf("double")
    def run(e: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(np.where(e.notna() & p.notna(), saturated_temperature(e.to_numpy(float, na_value=np.nan), p.to_numpy(float, na_value=np.nan)), np.nan))

    return levels.withColumn("adiabat", run(theta_e.cast("double"), pressure.cast("double"))).withColumn("adiabat", F.when(~F.isnan("adiabat"), F.col("adiabat")))
