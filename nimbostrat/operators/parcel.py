"""Parcel ascent and descent: iterative numerics over whole profiles.

Profiles come as one row a cell with arrays; each Arrow batch is a matrix of
cells by levels, and all cells take each step together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbostrat.functions.thermo import CP_DRY, DRY_LAPSE, EPSILON, GRAVITY, KAPPA, LATENT, R_DRY

MOST_STEP_M = 300.0


def vapour_pressure(t: np.ndarray) -> np.ndarray:
    c = t - 273.15
    return 6.112 * np.exp(17.67 * c / (c + 243.5))


def mixing_ratio(e: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.where((e > 0) & (e < p), EPSILON * e / np.where(e < p, p - e, np.nan), np.nan)


def virtual(t: np.ndarray, w: np.ndarray) -> np.ndarray:
    return t * (1 + w / EPSILON) / (1 + w)


def lcl_temperature(t: np.ndarray, td: np.ndarray) -> np.ndarray:
    return 56.0 + 1.0 / (1.0 / (td - 56.0) + np.log(t / td) / 800.0)


def moist_lapse(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    w = mixing_ratio(vapour_pressure(t), p)
    return GRAVITY * (1 + LATENT * w / (R_DRY * t)) / (CP_DRY + LATENT * LATENT * w * EPSILON / (R_DRY * t * t))


def moist_move(t: np.ndarray, z0: np.ndarray, z1: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Temperature after a saturated move from z0 to z1, in equal steps of at most 300 m."""
    depth = z1 - z0
    steps = np.maximum(1, np.ceil(np.abs(np.nan_to_num(depth)) / MOST_STEP_M)).astype(int)
    step = depth / steps
    t, live = np.array(t, float), np.flatnonzero(depth != 0)
    for k in range(int(steps.max(initial=1))):
        live = live[k < steps[live]]
        t[live] -= moist_lapse(t[live], p[live]) * step[live]
    return t


def arrays(profiles: DataFrame) -> DataFrame:
    """One row a cell: p, z, t, td as arrays from the lowest level up; complete levels only."""
    from nimbostrat.functions.thermo import dewpoint_from_rh

    rows = profiles.withColumn("td", dewpoint_from_rh(F.col("t"), F.col("rh"))).where("z IS NOT NULL AND p IS NOT NULL AND t IS NOT NULL AND td IS NOT NULL")
    levels = F.sort_array(F.collect_list(F.struct("z", "p", "t", "td")))
    return rows.groupBy("cell").agg(levels.alias("x")).select("cell", *[F.col(f"x.{c}").alias(c) for c in ("p", "z", "t", "td")])


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.full((len(column), width), np.nan)
    for k, row in enumerate(column):
        out[k, : len(row)] = row
    return out


def _lists(column: pa.Array, width: int) -> np.ndarray:
    """A matrix of an Arrow column of lists, padded with NaN."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), width), np.nan)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def by_column(rows: DataFrame, found: Callable[..., dict[str, np.ndarray | pa.Array]], together: int, schema: str, more: tuple[str, ...] = (), least: int = 2) -> DataFrame:
    """cell and ``schema``: what ``found`` gives for matrices p, z, t, td (and ``more`` numbers of a cell), ``together`` at once.

    rows: of ``arrays``. Cells are put in order of their lowest level and then of
    the whole column, so that equal columns stand together and are computed once, and parcels of
    one start meet in a batch. Ties are ordered by cell: a frequent column is spread over tasks.
    """
    start = [F.col(c)[0] for c in ("p", "t", "td")]
    order = [*start, "p", "t", "td", "z", "cell"]
    names = [n.split()[0] for n in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            width = max(int(np.diff(batch.column(1).offsets.to_numpy()).max()), least)
            columns = [_lists(batch.column(k), width) for k in range(1, 5)]
            columns += [batch.column(5 + k).to_numpy(zero_copy_only=False).astype(float)[:, None] for k in range(len(more))]
            bits = np.concatenate(columns, axis=1).view(np.int64)
            new = np.concatenate([[True], (bits[1:] != bits[:-1]).any(axis=1)])
            first, parts = np.flatnonzero(new), []
            for k in range(0, len(first), together):
                some = [c[first[k : k + together]] for c in columns]
                with np.errstate(all="ignore"):
                    one = found(*some[:4], *[c[:, 0] for c in some[4:]])
                parts.append([x if isinstance(x := one[n], pa.Array) else pa.array(x) for n in names])
            of = pa.array(np.cumsum(new) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.concat_arrays(list(c)).take(of) for c in zip(*parts, strict=True)]], names=["cell", *names])

    ordered = rows.select("cell", "p", "z", "t", "td", *more).repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, f"cell bigint, {schema}")


def cape_cin(p: np.ndarray, z: np.ndarray, t: np.ndarray, td: np.ndarray, source: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """CAPE and CIN (J/kg, CIN at most 0) of the lowest level's parcel, one segment per level pair.

    source: another parcel's p, z, t and td; levels below it don't count.

    A segment is judged at its mean pressure and temperature: dry ascent below
    the condensation level, saturated steps above. Negative segments count as
    CIN until the first positive one at or above condensation; after it only
    positive ones count, until buoyancy turns negative for the last time.
    """
    source_p, source_z, source_t, source_td = source or (p[:, 0], z[:, 0], t[:, 0], td[:, 0])
    source_td = np.minimum(source_td, source_t)
    lcl_t = lcl_temperature(source_t, source_td)
    lcl_p = source_p * (lcl_t / source_t) ** (1 / KAPPA)
    lcl_z = source_z + (source_t - lcl_t) / DRY_LAPSE
    w0 = mixing_ratio(vapour_pressure(source_td), source_p)
    cape, cin = np.zeros(len(p)), np.zeros(len(p))
    positive, parcel, at = np.zeros(len(p), bool), lcl_t.copy(), lcl_z.copy()
    for k in range(p.shape[1] - 1):
        dz = z[:, k + 1] - z[:, k]
        p_mid, z_mid = np.exp((np.log(p[:, k]) + np.log(p[:, k + 1])) / 2), (z[:, k] + z[:, k + 1]) / 2
        t_mid, td_mid = (t[:, k] + t[:, k + 1]) / 2, (td[:, k] + td[:, k + 1]) / 2
        ambient = virtual(t_mid, mixing_ratio(vapour_pressure(td_mid), p_mid))
        dry = (p_mid >= lcl_p) | (z_mid <= lcl_z)
        moist = moist_move(parcel, at, np.where(dry, at, z_mid), p_mid)
        dry_tv = virtual(source_t * (p_mid / source_p) ** KAPPA, w0)
        tv = np.where(dry, dry_tv, virtual(moist, mixing_ratio(vapour_pressure(moist), p_mid)))
        work = GRAVITY * (tv - ambient) / np.maximum(180.0, ambient) * dz
        valid = np.isfinite(work) & (dz > 0) & (p_mid <= source_p)
        up = valid & (work > 0) & ~dry
        cape += np.where(up, work, 0.0)
        cin += np.where(valid & (work < 0) & ~positive, work, 0.0)
        positive |= up
        parcel, at = np.where(dry | ~valid, parcel, moist), np.where(dry | ~valid, at, z_mid)
    return cape, np.where(cape > 0, cin, 0.0)


def segments_at(p: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pressures (rows, n): the first pair of levels around each, -1 outside the profile, and the share of its way up by the logarithm."""
    at = np.full(target.shape, -1, np.int64)
    for k in range(p.shape[1] - 2, -1, -1):
        low, high = p[:, k : k + 1], p[:, k + 1 : k + 2]
        at[(low >= target) & (high <= target)] = k
    log = np.log(p)
    share = np.clip((np.log(target) - _picked(log, at)) / _picked(log[:, 1:] - log[:, :-1], at), 0, 1)
    return at, share


def _picked(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each row's values at its places; any value where there is no place."""
    return values.take(np.maximum(at, 0) + np.arange(len(at))[:, None] * values.shape[1])


def between(values: np.ndarray, at: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Values of ``segments_at``, linear between both levels; missing outside the profile."""
    return np.where(at >= 0, _picked(values[:, :-1], at) + _picked(values[:, 1:] - values[:, :-1], at) * share, np.nan)


def thermo_at(p: np.ndarray, z: np.ndarray, t: np.ndarray, td: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """z, t and td of each row's levels at pressures (rows, n), linear in their logarithm; missing outside the profile."""
    if p.shape[1] < 2:
        return tuple(np.full(target.shape, np.nan) for _ in range(3))
    at, share = segments_at(p, target)
    return between(z, at, share), between(t, at, share), between(td, at, share)


def equivalent(t: np.ndarray, td: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Bolton's equivalent potential temperature."""
    e = vapour_pressure(td)
    w = mixing_ratio(e, p)
    lcl = lcl_temperature(t, td)
    return t * (1000.0 / (p - e)) ** (KAPPA * (1 - 0.28 * w)) * np.exp((3376.0 / lcl - 2.54) * w * (1 + 0.81 * w))


def downdraft_cape(p: np.ndarray, z: np.ndarray, t: np.ndarray, td: np.ndarray, depth: float = 400.0, layer: int = 100, from_lowest: bool = True) -> np.ndarray:
    """DCAPE within 0..4000 J/kg.

    Each level within ``depth`` hPa of the lowest one is scored by the mean theta-e
    of the ``layer`` hPa above it, every hPa. The parcel starts in the middle of the
    layer of least mean, at its wet bulb, and descends saturated to the lowest level;
    negative buoyancy is added up by trapezoids. Missing without such a layer. Without
    ``from_lowest`` the lowest level, the ground, is no layer's bottom.
    """
    rows = np.arange(len(p))
    least, source_p = np.full(len(p), np.inf), np.full(len(p), np.nan)
    top = np.fmin.reduce(p, axis=1)
    for k in range(0 if from_lowest else 1, p.shape[1]):
        # only of layers that are a parcel's candidates and within the profile
        some = np.flatnonzero((p[:, k] >= p[:, 0] - depth) & (p[:, k] - layer >= top))
        if not len(some):
            continue
        steps = p[some, k : k + 1] - np.arange(layer + 1)
        # where pressure falls with every level, none below the layer's bottom takes part, save that it ends a pair there
        first = k - 1 if k and (p[some, 1 : k + 1] < p[some, :k]).all() else 0
        at, share = segments_at(p[some, first:], steps)
        mean = equivalent(between(t[some, first:], at, share), between(td[some, first:], at, share), steps).mean(axis=1)
        better = np.isfinite(mean) & (mean < least[some])
        least[some], source_p[some] = np.where(better, mean, least[some]), np.where(better, p[some, k] - layer / 2, source_p[some])
    height, warm, dew = (x[:, 0] for x in thermo_at(p, z, t, td, source_p[:, None]))
    parcel, at_p, env, total = wet_bulb(warm, np.minimum(dew, warm), source_p), source_p.copy(), warm, np.zeros(len(p))
    for k in range(p.shape[1] - 1, -1, -1):
        below = np.isfinite(p[:, k]) & (p[:, k] > source_p)
        if not below.any():
            continue
        lower = np.full(len(p), np.nan)
        some = rows[below & np.isfinite(parcel)]
        lower[some] = moist_lift(at_p[some], parcel[some], p[some, k])
        go = below & np.isfinite(lower)
        work = GRAVITY * ((parcel - env) / env + (lower - t[:, k]) / t[:, k]) / 2 * (z[:, k] - height)
        total += np.where(go & np.isfinite(work), work, 0.0)
        parcel, at_p = np.where(go, lower, parcel), np.where(go, p[:, k], at_p)
        env, height = np.where(go, t[:, k], env), np.where(go, z[:, k], height)
    return np.where(np.isfinite(parcel), np.clip(total, 0.0, 4000.0), np.nan)


def lifted(p: np.ndarray, t: np.ndarray, td: np.ndarray, target: float) -> tuple[np.ndarray, np.ndarray]:
    """Temperature and virtual temperature of parcels (p, t, td) lifted to a pressure: dry, then saturated."""
    dew = np.minimum(td, t)
    lcl = lcl_temperature(t, dew)
    lcl_p = p * (lcl / t) ** (1 / KAPPA)
    dry = target >= lcl_p
    temperature = np.where(dry, t * (target / p) ** KAPPA, moist_lift(np.where(dry, target, lcl_p), lcl, np.full(len(p), target)))
    w = np.where(dry, mixing_ratio(vapour_pressure(dew), p), mixing_ratio(vapour_pressure(temperature), np.full(len(p), target)))
    good = target <= p + 1
    return np.where(good, temperature, np.nan), np.where(good, virtual(temperature, w), np.nan)


def buoyancy_levels(p: np.ndarray, z: np.ndarray, t: np.ndarray, td: np.ndarray, step: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """Heights above the lowest level at which its parcel becomes and stops being buoyant, sampled every ``step`` hPa.

    Buoyancy counts from condensation up; a crossing is interpolated between its
    samples. A parcel that is buoyant at the last sample stops there; one that never
    is has neither.
    """
    n, top = len(p), np.nanmin(p, axis=1)
    deepest = np.nanmax(p[:, 0] - top)
    count = int(max(deepest, 0) // step) + 1 if np.isfinite(deepest) else 1
    at = p[:, :1] - step * np.arange(count)
    height, warm, dew = thermo_at(p, z, t, td, at)
    env = virtual(warm, mixing_ratio(vapour_pressure(np.minimum(dew, warm)), at))
    source_td = np.minimum(td[:, 0], t[:, 0])
    lcl = lcl_temperature(t[:, 0], source_td)
    lcl_p = p[:, 0] * (lcl / t[:, 0]) ** (1 / KAPPA)
    moist = at < lcl_p[:, None]
    lift = np.full(at.shape, np.nan)
    rows, cols = np.nonzero(moist & np.isfinite(height))
    lift[rows, cols] = moist_lift(lcl_p[rows], lcl[rows], at[rows, cols])
    lifted_tv = virtual(lift, mixing_ratio(vapour_pressure(lift), at))
    force = GRAVITY * (lifted_tv - env) / np.maximum(180.0, env)
    up = force > 0
    some = up.any(axis=1)
    first, last = up.argmax(axis=1), count - 1 - up[:, ::-1].argmax(axis=1)
    each, above = np.arange(n), height - z[:, :1]

    def crossing(low: np.ndarray, high: np.ndarray, plain: np.ndarray) -> np.ndarray:
        a, b = force[each, low], force[each, high]
        share = np.clip(-a / np.where(b == a, 1.0, b - a), 0, 1)
        found = above[each, low] + (above[each, high] - above[each, low]) * share
        return np.where(np.isfinite(found) & (np.abs(b - a) > 1e-9) & (low != high), found, above[each, plain])

    free = crossing(np.maximum(first - 1, 0), first, first)
    level = crossing(last, np.minimum(last + 1, count - 1), last)
    return np.where(some, free, np.nan), np.where(some, level, np.nan)


def stability(p: np.ndarray, z: np.ndarray, t: np.ndarray, td: np.ndarray) -> dict[str, np.ndarray]:
    """Lifted index (virtual temperatures at 500 hPa), Showalter index, wet-bulb zero height, mixed-layer and most unstable CAPE and CIN."""
    n = len(p)
    at = lambda x: [v[:, 0] for v in thermo_at(p, z, t, td, np.full((n, 1), x))]
    (_, t5, d5), (_, t8, d8) = at(500.0), at(850.0)
    env = virtual(t5, mixing_ratio(vapour_pressure(np.minimum(d5, t5)), np.full(n, 500.0)))
    out = {"lifted_index": env - lifted(p[:, 0], t[:, 0], td[:, 0], 500.0)[1], "showalter": t5 - lifted(np.full(n, 850.0), t8, d8, 500.0)[0]}
    wet = np.stack([wet_bulb(t[:, k], np.minimum(td[:, k], t[:, k]), p[:, k]) for k in range(p.shape[1])], axis=1) - 273.15
    zero = np.full(n, np.nan)
    for k in range(p.shape[1] - 1):
        a, b = wet[:, k], wet[:, k + 1]
        cross = np.isnan(zero) & ((a >= 0) & (b <= 0) | (a <= 0) & (b >= 0))
        share = np.where(np.abs(b - a) < 1e-9, 0.0, np.clip(-a / np.where(b == a, 1.0, b - a), 0, 1))
        zero = np.where(cross, z[:, k] + (z[:, k + 1] - z[:, k]) * share, zero)
    out["wet_bulb_zero"] = zero
    out["lfc_m"], out["el_m"] = buoyancy_levels(p, z, t, td)
    steps = p[:, :1] - np.arange(0, 301)
    height, warm, dew = thermo_at(p, z, t, td, steps)
    theta = np.where(height - z[:, :1] <= 4000, equivalent(warm, dew, steps), np.nan)
    best = np.where(np.isfinite(theta), theta, -np.inf).argmax(axis=1)
    rows = np.arange(n)
    out["mu_cape"], out["mu_cin"] = cape_cin(p, z, t, td, (steps[rows, best], height[rows, best], warm[rows, best], dew[rows, best]))
    return out


def stability_indices(profiles: DataFrame, mixed: DataFrame | None = None) -> DataFrame:
    """cell, lifted_index, showalter, wet_bulb_zero, lfc_m, el_m, mu_cape, mu_cin, ml_cape, ml_cin of profiles.

    mixed: cell, p, t, td of mixed-layer parcels (``column.mixed_layer``); without it
    its two are missing. Cells of fewer than three complete levels are missing.
    """
    names = ["lifted_index", "showalter", "wet_bulb_zero", "lfc_m", "el_m", "mu_cape", "mu_cin", "ml_cape", "ml_cin"]
    rows = arrays(profiles)
    if mixed is not None:
        rows = rows.join(mixed.select("cell", F.struct("p", "t", "td").alias("mixed")), "cell", "left")
    else:
        rows = rows.withColumn("mixed", F.lit(None).cast("struct<p:double,t:double,td:double>"))
    rows = rows.select("cell", "p", "z", "t", "td", *[F.col(f"mixed.{c}").alias(f"m_{c}") for c in ("p", "t", "td")])

    def found(p: np.ndarray, z: np.ndarray, t: np.ndarray, td: np.ndarray, *own: np.ndarray) -> dict[str, np.ndarray]:
        out = stability(p, z, t, td)
        out["ml_cape"], out["ml_cin"] = cape_cin(p, z, t, td, (own[0], z[:, 0], own[1], own[2]))
        enough, known = np.isfinite(p).sum(axis=1) >= 3, np.isfinite(own[0])
        return {k: np.where(enough & (known | (not k.startswith("ml_"))), out[k], np.nan) for k in names}

    out = by_column(rows, found, 2048, ", ".join(f"{k} double" for k in names), ("m_p", "m_t", "m_td"))
    return out.select("cell", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names])


def parcel_indices(profiles: DataFrame) -> DataFrame:
    """cell, cape, cin, dcape of profiles; cells with fewer than three complete levels are missing."""

    def found(p: np.ndarray, z: np.ndarray, t: np.ndarray, td: np.ndarray) -> dict[str, np.ndarray]:
        cape, cin = cape_cin(p, z, t, td)
        enough = np.isfinite(p).sum(axis=1) >= 3
        return {n: np.where(enough, x, np.nan) for n, x in (("cape", cape), ("cin", cin), ("dcape", downdraft_cape(p, z, t, td)))}

    out = by_column(arrays(profiles), found, 4096, "cape double, cin double, dcape double")
    return out.select("cell", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("cape", "cin", "dcape")])


# Coefficients of the Wobus function, lowest power first, below and above 20 C.
WOBUS_COLD = [1.0, -8.841660499999999e-3, 1.4714143e-4, -9.671989000000001e-7, -3.2607217e-8, -3.8598073e-10]
WOBUS_WARM = [1.0, 3.6182989e-3, -1.3603273e-5, 4.9618922e-7, -6.1059365e-9, 3.9401551e-11, -1.2588129e-13, 1.668828e-16]


def _powers(x: np.ndarray, coefficients: list[float]) -> np.ndarray:
    out = np.full_like(x, coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out *= x
        out += c
    return out


def wobus(t_c: np.ndarray) -> np.ndarray:
    x = np.atleast_1d(np.asarray(t_c, float) - 20.0)
    out, warm = np.empty_like(x), x > 0
    cold = ~warm
    c, w = _powers(x[cold], WOBUS_COLD), _powers(x[warm], WOBUS_WARM)
    c *= c
    w *= w
    out[cold], out[warm] = 15.13 / (c * c), 29.93 / (w * w) + 0.96 * x[warm] - 14.8
    return out.reshape(np.shape(t_c))


def saturated_lift(p: np.ndarray, theta_c: np.ndarray, close: float = 0.1, rounds: int = 80) -> np.ndarray:
    """Temperature in C at p of a saturated parcel, by the secant method on the Wobus function; parcels that have settled take no further part."""
    shape = np.broadcast(p, theta_c).shape
    every_p, every_theta = (np.broadcast_to(x, shape).astype(float).ravel() for x in (p, theta_c))
    settled, live = np.full(every_p.shape, np.nan), np.arange(every_p.size)
    theta, power = every_theta, (every_p / 1000.0) ** KAPPA
    before = (theta + 273.15) * power - 273.15
    gap_before, rate = wobus(before) - wobus(theta), np.ones_like(before)
    for last in range(rounds - 1, -1, -1):
        if not len(live):
            break
        now = before - gap_before * rate
        potential = (now + 273.15) / power - 273.15
        gap = potential + wobus(now) - wobus(potential) - theta
        error = gap * rate
        move = np.abs(error) > close
        done = np.flatnonzero(~move) if last else slice(None)
        settled[live[done]] = (now - error)[done]
        with np.errstate(all="ignore"):
            rate = (now - before) / (gap - gap_before)
        live, theta, power, before, gap_before, rate = (x[move] for x in (live, theta, power, now, gap, rate))
    return np.where(np.abs(every_p - 1000.0) <= 0.001, every_theta, settled).reshape(shape)


def moist_lift(p0: np.ndarray, t0: np.ndarray, p1: np.ndarray) -> np.ndarray:
    """Kelvins at p1 of a parcel saturated at (p0, t0)."""
    c = t0 - 273.15
    theta = t0 * (1000.0 / p0) ** KAPPA - 273.15
    return saturated_lift(p1, theta - wobus(theta) + wobus(c)) + 273.15


def wet_bulb(t: np.ndarray, td: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Normand's wet bulb in kelvins: dry ascent to condensation, saturated descent back."""
    lcl = lcl_temperature(t, np.minimum(td, t))
    return moist_lift(p * (lcl / t) ** (1 / KAPPA), lcl, p)


def wet_bulbs(levels: DataFrame) -> DataFrame:
    """levels (t, td, p) with ``wet_bulb``."""

    @F.pandas_udf("double")
    def run(t: pd.Series, td: pd.Series, p: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return pd.Series(wet_bulb(t.to_numpy(float), td.to_numpy(float), p.to_numpy(float)))

    out = run(F.col("t").cast("double"), F.col("td").cast("double"), F.col("p").cast("double"))
    return levels.withColumn("wet_bulb", out).withColumn("wet_bulb", F.when(~F.isnan("wet_bulb"), F.col("wet_bulb")))


def _from_level(p: np.ndarray, z: np.ndarray, t: np.ndarray, td: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return cape_cin(p[:, k:], z[:, k:], t[:, k:], td[:, k:])


def effective_layer(p: np.ndarray, z: np.ndarray, t: np.ndarray, td: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, top, most CAPE): heights of the first and last of consecutive source levels with CAPE >= 100 and CIN >= -250.

    Sources lie within 300 hPa and 4 km of the lowest level, 25 hPa apart at least.
    """
    n = len(p)
    base, top, most = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n)
    ended, last_p = np.zeros(n, bool), np.full(n, np.inf)
    for k in range(p.shape[1] - 2):
        source = (p[:, k] >= p[:, 0] - 300) & (z[:, k] - z[:, 0] <= 4000) & (last_p - p[:, k] >= 25) & ~ended
        if not source.any():
            continue
        cape, cin = _from_level(p, z, t, td, k)
        passes = source & (cape >= 100) & (cin >= -250)
        ended |= source & ~passes & np.isfinite(base)
        base = np.where(passes & np.isnan(base), z[:, k] - z[:, 0], base)
        top = np.where(passes, z[:, k] - z[:, 0], top)
        most = np.where(source & (cape > most), cape, most)
        last_p = np.where(source, p[:, k], last_p)
    return base, top, most


def effective_layers(profiles: DataFrame) -> DataFrame:
    """cell, base_m, top_m, mucape of profiles; missing without an effective layer."""
    names = ("base_m", "top_m", "mucape")
    found = lambda *column: dict(zip(names, effective_layer(*column), strict=True))
    out = by_column(arrays(profiles), found, 4096, "base_m double, top_m double, mucape double", least=3)
    return out.select("cell", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("base_m", "top_m", "mucape")])
