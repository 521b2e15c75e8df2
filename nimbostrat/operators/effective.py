"""Effective inflow layers and the fields derived from whole columns, for the cells that need them.

The search for the layer tries a parcel from one level after another, which is the
costly part; cheap fields say beforehand in which cells it can matter.  Where only its
products are wanted, other cells are left out before their levels are gathered;
where fields of all cells are wanted, only those cells are searched.
What follows the search works on the same matrices of cells by levels, with bottoms
and tops that differ by cell, so all fields together cost one shuffle of the levels and one trip to Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbostrat.functions import severe, thermo
from nimbostrat.functions.units import MPS_TO_KT
from nimbostrat.operators import column
from nimbostrat.operators.ascent import TOGETHER, Source, segments
from nimbostrat.operators.parcel import _lists, downdraft_cape, lcl_temperature, mixing_ratio, vapour_pressure

# What makes a parcel part of the inflow, and where sources may lie.
LEAST_CAPE, LEAST_CIN = 100.0, -250.0
DEEPEST_HPA, SOURCE_STEP_HPA, HIGHEST_M = 300.0, 25.0, 4000.0
#: A layer's top counts as this far above its base at least.
THINNEST_M = 1.0
#: Share of the way to the equilibrium level of the layers for motion and for shear; deviation of a storm in m/s.
MOTION_SHARE, SHEAR_SHARE, DEVIATION = 0.65, 0.5, 7.5
PRODUCTS = ("lapse_0_3km", "shear_0_6km_kt", "shear_effective_kt", "dcape", "scp_effective", "stp_effective")
GIVEN = ("mlcape", "mlcin", "sbcape", "sbcin", "mucape")
KINEMATICS = ("motion_u", "motion_v", "esrh", "ebwd_kt")
#: What is known of a cell that was searched.
SEARCHED = ("base_m", "top_m", "most_cape", "el_m", *KINEMATICS, "ml_lcl_m")
#: Cells of which the matrices are held at once.
CELLS = 2048


def may_have_layer(scp: bool = True, stp: bool = True) -> Column:
    """Whether given CAPE and CIN let a cell have a composite above zero; missing values don't."""
    enough = lambda c: F.coalesce(F.col(c) >= LEAST_CAPE, F.lit(False))
    tornado = F.coalesce(F.col("mlcape") > 0, F.lit(False)) & F.coalesce(F.col("mlcin") > -200, F.lit(True)) & (enough("mucape") | enough("mlcape") | enough("sbcape"))
    return enough("mucape") & F.lit(scp) | tornado & F.lit(stp)


def inflow_layer(p: np.ndarray, agl: np.ndarray, t: np.ndarray, td: np.ndarray) -> dict[str, np.ndarray]:
    """base_m, top_m of the first run of source levels with enough CAPE and little CIN, and the most unstable source's CAPE, CIN and equilibrium level.

    Sources are levels within 300 hPa and 4 km of the lowest one, 25 hPa apart at
    least, tried from below until the run ends. Missing without a run.
    """
    n = len(p)
    base, last, open_ = np.full(n, np.nan), np.full(n, np.nan), np.isfinite(p[:, 0])
    most, most_cin, el, tried = np.full(n, -np.inf), np.full(n, np.nan), np.full(n, np.nan), np.full(n, np.nan)
    for k in range(p.shape[1]):
        here = open_ & np.isfinite(p[:, k] + agl[:, k] + t[:, k] + td[:, k]) & (agl[:, k] <= HIGHEST_M)
        open_ &= ~(here & (p[:, k] < p[:, 0] - DEEPEST_HPA))
        here &= open_ & ~(tried - p[:, k] < SOURCE_STEP_HPA)
        rows = np.flatnonzero(here)
        if not len(rows):
            continue
        tried[rows] = p[rows, k]
        found = segments(p[rows], agl[rows], t[rows], td[rows], Source(p[rows, k], agl[rows, k], t[rows, k], td[rows, k]))
        cape, cin = found["cape"], found["cin"]
        inside, known = np.isfinite(base[rows]), np.isfinite(cape) & np.isfinite(cin)
        better = known & (cape > most[rows])
        for values, new in ((most, cape), (most_cin, cin), (el, found["el_m"])):
            values[rows] = np.where(better, new, values[rows])
        passes = known & (cape >= LEAST_CAPE) & (cin >= LEAST_CIN)
        base[rows] = np.where(passes & ~inside, np.maximum(0, agl[rows, k]), base[rows])
        last[rows] = np.where(passes, np.maximum(base[rows], agl[rows, k]), last[rows])
        open_[rows] &= ~(inside & ~passes)
    run = np.isfinite(base) & np.isfinite(last)
    return {k: np.where(run, v, np.nan) for k, v in (("base_m", base), ("top_m", last), ("most_cape", np.maximum(0, most)), ("most_cin", most_cin), ("el_m", el))}


def _packed(known: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The matrices without the levels that aren't known: each cell's others move together."""
    if known[:, :-1].all():
        return [np.where(known, v, np.nan) for v in values]
    order = np.argsort(~known, axis=1, kind="stable")
    return [np.take_along_axis(np.where(known, v, np.nan), order, axis=1) for v in values]


def _pick(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return values[np.arange(len(at)), at]


def _at_height(height: np.ndarray, agl: np.ndarray, *values: np.ndarray, p: np.ndarray | None = None) -> list[np.ndarray]:
    """Each cell's values at a height of its own: p (given, it comes first) by its logarithm, the rest linear; missing outside the column."""
    h = height[:, None]
    low, high = (agl <= h).sum(axis=1) - 1, (agl < h).sum(axis=1)
    inside = (low >= 0) & np.isfinite(height)
    high = np.minimum(high, agl.shape[1] - 1)
    inside &= np.isfinite(_pick(agl, high)) & (_pick(agl, high) >= height)
    z0, z1 = _pick(agl, low), _pick(agl, high)
    part = np.where(z1 == z0, 0.0, (height - z0) / np.where(z1 == z0, 1.0, z1 - z0))
    out = [_pick(v, low) + (_pick(v, high) - _pick(v, low)) * part for v in values]
    if p is not None:
        a, b = _pick(p, low), _pick(p, high)
        out.insert(0, np.where(part == 0, a, np.exp(np.log(a) + (np.log(b) - np.log(a)) * part)))
    return [np.where(inside, v, np.nan) for v in out]


def _simpson(p: np.ndarray, values: list[np.ndarray], bottom: list[np.ndarray], top: list[np.ndarray], of: Callable[..., list[np.ndarray]]) -> list[np.ndarray]:
    """Integrals over pressure between two levels [p, *values] of what ``of`` gives for p and values; the middle of a
    segment takes values linear in the logarithm of pressure. Missing unless the bottom lies below the top."""
    last, low = list(bottom), of(*bottom)
    total = [np.zeros(len(p)) for _ in low]
    for k in range(p.shape[1] + 1):
        if k < p.shape[1]:
            use, here = (p[:, k] < bottom[0]) & (p[:, k] > top[0]), [p[:, k], *[v[:, k] for v in values]]
        else:
            use, here = np.ones(len(p), bool), list(top)
        if not use.any():
            continue
        dp, middle = last[0] - here[0], (last[0] + here[0]) / 2
        between = np.log(here[0]) - np.log(last[0])
        share = np.where(between == 0, 0.0, (np.log(middle) - np.log(last[0])) / np.where(between == 0, 1.0, between))
        mid, high = of(middle, *[a + (b - a) * share for a, b in zip(last[1:], here[1:], strict=True)]), of(*here)
        total = [np.where(use, s + (a + 4 * m + b) / 6 * dp, s) for s, a, m, b in zip(total, low, mid, high, strict=True)]
        last, low = ([np.where(use, b, a) for a, b in zip(x, y, strict=True)] for x, y in ((last, here), (low, high)))
    return [np.where(bottom[0] > top[0], s, np.nan) for s in total]


def layer_kinematics(p: np.ndarray, agl: np.ndarray, u: np.ndarray, v: np.ndarray, base: np.ndarray, top: np.ndarray, most_cape: np.ndarray, el: np.ndarray) -> dict[str, np.ndarray]:
    """motion_u, motion_v, esrh and ebwd_kt of each cell's own layer.

    The storm's motion is that of the layer from the base to 0.65 of the way to the
    equilibrium level, the mean weighted by pressure, where that reaches 3 km; else that of
    the lowest 6 km. Shear is between the base and half way to the equilibrium level.
    """
    top = np.fmax(top, base + THINNEST_M)
    deep = base + (el - base) * MOTION_SHARE
    deep = np.where((most_cape > LEAST_CAPE) & (el > base + 500) & (deep >= 3000), deep, np.nan)
    half = base + SHEAR_SHARE * np.fmax(0.0, np.where(np.isfinite(el), el, top) - base)
    at = lambda height: _at_height(height, agl, u, v, p=p)
    at_base, at_top, at_half, at_deep, at_6km, at_0 = (at(np.broadcast_to(h, len(p)).astype(float)) for h in (base, top, half, deep, 6000.0, 0.0))
    motion = [np.full(len(p), np.nan)] * 2
    for low, high, weight in ((at_base, at_deep, True), (at_0, at_6km, False)):
        w, wu, wv = _simpson(p, [u, v], low, high, (lambda p, u, v: [p, p * u, p * v]) if weight else (lambda p, u, v: [np.ones(len(p)), u, v]))
        du, dv = high[1] - low[1], high[2] - low[2]
        size = np.sqrt(du * du + dv * dv)
        moved = [np.where(size >= 1e-6, x, np.nan) for x in (wu / w + DEVIATION * dv / size, wv / w - DEVIATION * du / size)]
        motion = [np.where(np.isfinite(a), a, b) for a, b in zip(motion, moved, strict=True)]
    # the motion's part depends only on the winds at both ends, so the sum over the levels is taken without it
    total, last_u, last_v = np.zeros(len(p)), at_base[1], at_base[2]
    for k in range(p.shape[1] + 1):
        inner = k < p.shape[1]
        use = (agl[:, k] > base) & (agl[:, k] < top) if inner else np.ones(len(p), bool)
        x, y = (u[:, k], v[:, k]) if inner else at_top[1:]
        total = np.where(use, total + (x * last_v - last_u * y), total)
        last_u, last_v = np.where(use, x, last_u), np.where(use, y, last_v)
    esrh = total + motion[1] * (at_base[1] - at_top[1]) + motion[0] * (at_top[2] - at_base[2])
    du, dv = at_half[1] - at_base[1], at_half[2] - at_base[2]
    return {"motion_u": motion[0], "motion_v": motion[1], "esrh": np.where(top > base, esrh, np.nan), "ebwd_kt": np.sqrt(du * du + dv * dv) * MPS_TO_KT}


def mixed_condensation(p: np.ndarray, t: np.ndarray, td: np.ndarray, depth: float = 100.0) -> np.ndarray:
    """Metres to condensation of the parcel mixed of the lowest ``depth`` hPa, as ``column.mixed_parcels`` mixes it."""
    target, dew = p[:, 0] - depth, np.minimum(td, t)
    below, above = p >= target[:, None], p <= target[:, None]
    low, high = p.shape[1] - 1 - below[:, ::-1].argmax(axis=1), above.argmax(axis=1)
    found = below.any(axis=1) & above.any(axis=1)
    a, b = np.log(_pick(p, low)), np.log(_pick(p, high))
    share = np.where(a == b, 0.0, (np.log(target) - a) / np.where(a == b, 1.0, b - a))
    end = [np.where(found, x, np.nan) for x in (target, *[_pick(v, low) + (_pick(v, high) - _pick(v, low)) * share for v in (t, dew)])]
    mean = _simpson(p, [t, dew], [p[:, 0], t[:, 0], dew[:, 0]], end, lambda p, t, d: [np.ones(len(p)), t * (1000.0 / p) ** thermo.KAPPA, mixing_ratio(vapour_pressure(d), p)])
    warm, w = mean[1] / mean[0] * (p[:, 0] / 1000.0) ** thermo.KAPPA, mean[2] / mean[0]
    e = w * p[:, 0] / (thermo.EPSILON + w)
    x = np.log(np.where(e > 0, e, np.nan) / 6.112)
    return np.maximum(0.0, (warm - lcl_temperature(warm, 243.5 * x / (17.67 - x) + thermo.ZERO_C)) / thermo.DRY_LAPSE)


def _by_cell(rows: DataFrame, fields: tuple[str, ...], found: Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], dict[str, np.ndarray]], names: tuple[str, ...]) -> DataFrame:
    """``rows`` without levels, and ``names``: what ``found`` gives for matrices of the levels' ``fields`` and the other columns, many cells at once; NaN is missing."""
    given, arrays = [c for c in rows.columns if c != "levels"], {c: column.fresh(c) for c in fields}
    flat = rows.select(*given, *[F.col("levels").getField(c).alias(x) for c, x in arrays.items()])
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema if f.name in given]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CELLS):
                batch = whole.slice(start, CELLS)
                width = max(int(pc.max(pc.list_value_length(batch.column(arrays[fields[0]]))).as_py() or 0), 2)
                levels = {c: _lists(batch.column(x), width) for c, x in arrays.items()}
                with np.errstate(all="ignore"):
                    out = found(levels, {c: batch.column(c).to_numpy(zero_copy_only=False) for c in given})
                new = [pa.array(out[n], pa.float64(), mask=np.isnan(out[n])) for n in names]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in given], *new], names=[*given, *names])

    return flat.mapInArrow(run, ", ".join([*types, *[f"{n} double" for n in names]]))


def _some(rows: np.ndarray, n: int, found: Callable[..., dict[str, np.ndarray]], *values: np.ndarray, together: int = CELLS) -> dict[str, np.ndarray]:
    """What ``found`` gives for the chosen rows of the values, ``together`` at once; missing in the others."""
    out: dict[str, np.ndarray] = {}
    for start in range(0, max(len(rows), 1), together):
        some = rows[start : start + together]
        for name, x in found(*[v[some] for v in values]).items():
            out.setdefault(name, np.full(n, np.nan))[some] = x
    return out


def kinematics(rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` but levels, with motion_u, motion_v, esrh and ebwd_kt of each cell's own layer (``layer_kinematics``).

    rows: cell, levels with u and v, base_m, top_m, most_cape and el_m.
    """
    found = lambda x, row: layer_kinematics(*(x[c] for c in ("p", "agl", "u", "v")), *(row[c].astype(float) for c in ("base_m", "top_m", "most_cape", "el_m")))
    return _by_cell(rows, ("p", "agl", "u", "v"), found, KINEMATICS)


def _gathered(profiles: DataFrame) -> DataFrame:
    """cell and its levels with winds; t and td may be missing in some of them."""
    td = thermo.dewpoint_from_rh(F.col("t"), F.col("rh"))
    return column.columns(profiles.withColumn("td", td), column.WINDS, ("t", "td"))


def _searched(x: dict[str, np.ndarray], searched: np.ndarray) -> dict[str, np.ndarray]:
    """The layer, its kinematics and the mixed parcel's condensation of the cells that are searched; missing in the others."""
    names, n, rows = ("p", "agl", "t", "td", "u", "v"), len(searched), np.flatnonzero(searched)

    def found(p: np.ndarray, agl: np.ndarray, t: np.ndarray, td: np.ndarray, u: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        layer = inflow_layer(p, agl, t, td)
        moving = layer_kinematics(p, agl, u, v, *(layer[c] for c in ("base_m", "top_m", "most_cape", "el_m")))
        return {**layer, **moving, "ml_lcl_m": mixed_condensation(*_packed(np.isfinite(t) & np.isfinite(td), p, t, td))}

    return _some(rows, n, found, *(x[c] for c in names))


def _composites(rows: DataFrame) -> DataFrame:
    """``rows`` of ``_searched`` with scp_effective and stp_effective."""
    scp = severe.supercell_composite(F.coalesce("mucape", "most_cape"), F.col("esrh"), F.col("ebwd_kt"))
    stp = severe.effective_tornado_parameter(F.col("mlcape"), F.col("mlcin"), F.col("ml_lcl_m"), F.col("esrh"), F.col("ebwd_kt"), F.col("base_m"))
    return rows.withColumns({"scp_effective": scp, "stp_effective": F.when(F.col("base_m") > 0, F.when(F.col("esrh").isNotNull(), 0.0)).otherwise(stp)})


def effective_products(profiles: DataFrame, cells: DataFrame) -> DataFrame:
    """The candidate cells with their effective layer, its motion, helicity and shear, and both composites.

    profiles: cell, p, z, t, rh, u, v, the lowest level being the ground; cells: cell and the
    given CAPE and CIN. Other cells leave before their levels are gathered, and so
    are absent; a candidate without a layer has missing values.
    """
    chosen = cells.where(may_have_layer()).select("cell", *GIVEN)
    rows = _gathered(profiles.join(chosen.select("cell"), "cell", "left_semi")).join(chosen, "cell").where(F.size("levels") >= 3)
    out = _composites(_by_cell(rows, ("p", "agl", "t", "td", "u", "v"), lambda x, row: _searched(x, np.ones(len(row["cell"]), bool)), SEARCHED))
    return out.select("cell", "base_m", "top_m", "most_cape", "el_m", "motion_u", "motion_v", "esrh", "ebwd_kt", "ml_lcl_m", "scp_effective", "stp_effective")


def _derived(x: dict[str, np.ndarray], row: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What ``_searched`` gives, and dcape, shear_0_6km_kt and lapse_0_3km of all cells."""
    p, z, agl, t, td, u, v = (x[c] for c in ("p", "z", "agl", "t", "td", "u", "v"))
    n, whole = len(p), np.isfinite(t) & np.isfinite(td)
    deep = np.flatnonzero(whole.sum(axis=1) >= 3)
    out = _some(deep, n, lambda *columns: {"dcape": downdraft_cape(*columns, from_lowest=False)}, *_packed(whole, p, z, t, td), together=TOGETHER)
    (t3,) = _at_height(np.full(n, 3000.0), *_packed(np.isfinite(t), agl, t))
    u6, v6 = _at_height(np.full(n, 6000.0), agl, u, v)
    du, dv = u6 - u[:, 0], v6 - v[:, 0]
    return {**_searched(x, row["searched"].astype(bool)), **out, "shear_0_6km_kt": np.sqrt(du * du + dv * dv) * MPS_TO_KT, "lapse_0_3km": (t[:, 0] - t3) / 3.0}


def profile_derived_grids(profiles: DataFrame, cells: DataFrame) -> DataFrame:
    """All cells of ``profiles`` with the fields of ``PRODUCTS`` and whether the layer was searched.

    Effective shear is the 0-6 km shear where mixed-layer or surface parcels can feed a
    storm. Fields that a cell's profile or gate doesn't allow are missing; cells without
    given fields are no candidates.
    """
    rows = _gathered(profiles).join(cells.select("cell", *GIVEN), "cell", "left")
    rows = rows.withColumn("searched", may_have_layer() & (F.size("levels") >= 3))
    rows = _composites(_by_cell(rows, ("p", "z", "agl", "t", "td", "u", "v"), _derived, (*SEARCHED, "dcape", "shear_0_6km_kt", "lapse_0_3km")))
    feeds = severe.effective_candidate(F.col("mlcape"), F.col("mlcin"), F.col("sbcape"), F.col("sbcin"))
    rows = rows.withColumn("shear_effective_kt", F.when(feeds, F.col("shear_0_6km_kt")))
    return rows.select("cell", "searched", *PRODUCTS)
