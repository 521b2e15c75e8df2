"""Parcels of whole profiles against known soundings and plain loops."""

import math

import numpy as np
import pytest

from nimbostrat.operators import ascent, column, parcel

DRY = [(1008, 80, 38.0, None), (1000, 110, 36.0, 14), (925, 790, 29.5, 18), (850, 1500, 22.5, 24), (700, 3100, 8.0, 55), (500, 5800, -12.5, 40), (300, 9600, -38.0, 30)]
WET = [(1008, 80, 14.0, 99), (1000, 110, 14.0, 99), (925, 760, 10.0, 99), (850, 1430, 6.5, 99), (700, 2990, -1.5, 99), (500, 5560, -16.0, 95), (300, 9100, -40.0, 90)]


def dewpoint(c, rh):
    g = math.log(rh / 100) + 17.625 * c / (243.04 + c)
    return 243.04 * g / (17.625 - g)


def arrays(rows):
    p, z, t = (np.array([[r[k] for r in rows]], float) for k in range(3))
    td = np.array([[2.0 if r[3] is None else dewpoint(r[2], r[3]) for r in rows]])
    return p, z, t + 273.15, td + 273.15


def test_downdrafts_of_a_dry_and_a_saturated_profile():
    assert 500 < parcel.downdraft_cape(*arrays(DRY))[0] < 1100
    assert 0 <= parcel.downdraft_cape(*arrays(WET))[0] < 50


def test_downdraft_source_is_the_layer_of_least_mean():
    """The layer is found by a plain loop over levels and hectopascals."""
    p, z, t, td = arrays(DRY)
    best = None
    for k in range(p.shape[1]):
        if p[0, k] < p[0, 0] - 400:
            continue
        values = []
        for q in range(101):
            x = p[0, k] - q
            at = [parcel.thermo_at(p, z, t, td, np.array([[x]]))[i][0, 0] for i in (1, 2)]
            values.append(parcel.equivalent(np.array(at[0]), np.array(at[1]), np.array(x)))
        mean = np.mean(values)
        if np.isfinite(mean) and (best is None or mean < best[0]):
            best = (mean, p[0, k] - 50)
    # with only that source left the result is the same
    only = parcel.downdraft_cape(p, z, t, td)
    assert best is not None and np.isfinite(only[0])
    source_t = parcel.thermo_at(p, z, t, td, np.array([[best[1]]]))[1][0, 0]
    wet = parcel.wet_bulb(np.array([source_t]), parcel.thermo_at(p, z, t, td, np.array([[best[1]]]))[2][0], np.array([best[1]]))[0]
    energy, at_p, env, height = 0.0, best[1], source_t, parcel.thermo_at(p, z, t, td, np.array([[best[1]]]))[0][0, 0]
    for k in reversed(range(p.shape[1])):
        if p[0, k] > best[1]:
            low = parcel.moist_lift(np.array([at_p]), np.array([wet]), np.array([p[0, k]]))[0]
            energy += 9.80665 * ((wet - env) / env + (low - t[0, k]) / t[0, k]) / 2 * (z[0, k] - height)
            wet, at_p, env, height = low, p[0, k], t[0, k], z[0, k]
    assert only[0] == pytest.approx(min(4000, max(0, energy)), rel=1e-6)


def test_indices_of_stable_and_unstable_air():
    p, z, t, td = (np.concatenate(x) for x in zip(arrays(DRY), arrays(WET), strict=True))
    with np.errstate(all="ignore"):
        out = parcel.stability(p, z, t, td)
    # stable from the surface; the wet bulb is close to the temperature of saturated air
    assert out["lifted_index"][1] > 0 and 0 <= out["mu_cape"][1] < 300
    assert out["wet_bulb_zero"][1] == pytest.approx(2990 - 1560 * 1.5 / 8.0, abs=120)
    # a warmer, moister surface lowers the lifted index
    moister = parcel.stability(p, z, t + np.eye(1, 7) * 4, td + np.eye(1, 7) * 6)
    assert (moister["lifted_index"] < out["lifted_index"]).all()


def test_levels_of_buoyancy():
    """A warm moist parcel under a cap: buoyant between its free convection and its equilibrium."""
    rows = [(1000, 100, 30.0, 80), (900, 1050, 23.5, 40), (850, 1560, 22.0, 30), (700, 3150, 9.0, 30), (500, 5850, -10.0, 30), (300, 9600, -38.0, 30), (200, 12300, -52.0, 30), (150, 14200, -50.0, 30)]
    p, z, t, td = arrays(rows)
    with np.errstate(all="ignore"):
        free, level = parcel.buoyancy_levels(p, z, t, td)
        calm = parcel.buoyancy_levels(*arrays(WET))
    assert 300 < free[0] < 3500 and 9000 < level[0] < 14100
    # the lifted parcel is no colder than the air where it becomes buoyant, and meets it where it stops
    for h in (free[0], level[0]):
        at = math.exp(np.interp(h + 100, z[0], np.log(p[0])))
        heights, warm, dew = parcel.thermo_at(p, z, t, td, np.array([[at]]))
        air = parcel.virtual(warm[0], parcel.mixing_ratio(parcel.vapour_pressure(dew[0]), np.array([at])))
        lifted = parcel.lifted(p[:, 0], t[:, 0], td[:, 0], at)[1][0]
        assert lifted > air[0] - 0.35 and (h == free[0] or lifted < air[0] + 0.35)
    assert np.isnan(calm[0][0]) or calm[1][0] >= calm[0][0]


def test_saturated_parcels_lift_like_their_adiabat():
    at, virtual = parcel.lifted(np.array([1000.0]), np.array([293.15]), np.array([293.15]), 700.0)
    assert at[0] == pytest.approx(parcel.moist_lift(np.array([1000.0]), np.array([293.15]), np.array([700.0]))[0]) and virtual[0] > at[0]
    dry, _ = parcel.lifted(np.array([1000.0]), np.array([300.0]), np.array([260.0]), 900.0)
    assert dry[0] == pytest.approx(300 * 0.9**0.2854)
    assert np.isnan(parcel.lifted(np.array([800.0]), np.array([280.0]), np.array([270.0]), 850.0)[0][0])


LEVELS = "cell bigint, p double, z double, t double, rh double, u double, v double"


def simpson(rows, bottom, top, of):
    """Mean over pressure by a fine sum; rows of (p, value), linear in ln p."""
    ps, values = [r[0] for r in rows], [of(r) for r in rows]
    grid = np.linspace(bottom, top, 200_001)
    return np.interp(-np.log(grid), -np.log(ps), values).mean()


def test_mean_winds_match_fine_sums(spark):
    rows = [(1, p, z, 280.0, 50.0, u, v) for p, z, u, v in [(1000.0, 100.0, 2.0, 8.0), (900.0, 1000.0, 6.0, 9.0), (700.0, 3000.0, 14.0, 10.0), (500.0, 5600.0, 22.0, 11.0), (300.0, 9200.0, 40.0, 12.0)]]
    short = [(2, *r[1:]) for r in rows[:3]]
    out = {r["cell"]: r for r in column.mean_winds(spark.createDataFrame(rows + short, LEVELS), 6000.0).collect()}
    share = (6000 - 5500) / 3600
    top = math.exp(math.log(500) + (math.log(300) - math.log(500)) * share)
    whole = [(r[1], r[5], r[6]) for r in rows]
    assert out[1]["pu"] == pytest.approx(simpson(whole, 1000, top, lambda r: r[1]), abs=2e-3)
    heights, us = [0, 900, 2900, 5500, 6000], [2, 6, 14, 22, 22 + 18 * share]
    assert out[1]["u"] == pytest.approx(np.trapezoid(us, heights) / 6000)
    # a profile that ends below the top has no mean
    assert out[2]["u"] is None and out[2]["pu"] is None
    motion = {r["cell"]: r for r in column.storm_motions(spark.createDataFrame(rows + short, LEVELS)).collect()}
    assert motion[2]["right_u"] is None and motion[2]["srh"] is None
    su, sv = 20 + 18 * share, 3 + share
    assert motion[1]["right_u"] == pytest.approx(out[1]["pu"] + 7.5 * sv / math.hypot(su, sv)) and motion[1]["left_v"] == pytest.approx(out[1]["pv"] + 7.5 * su / math.hypot(su, sv))
    storm = column.corfidi(spark.createDataFrame(rows + short, LEVELS)).where("cell = 1").first()
    deep = simpson(whole, 850, 300, lambda r: r[1])
    low_top = math.exp(math.log(900) + (math.log(700) - math.log(900)) * (1500 - 900) / 2000)
    assert storm["upshear_u"] == pytest.approx(deep - simpson(whole, 1000, low_top, lambda r: r[1]), abs=4e-3)


def test_equal_columns_are_computed_once(spark):
    levels = "cell long, p array<double>, z array<double>, t array<double>, td array<double>"
    rows = spark.createDataFrame([(k, [1000.0, 900.0], [100.0, 1000.0], [290.0 + (k == 7), 280.0], [280.0, 270.0]) for k in range(300)], levels).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        out = {r["cell"]: (r["n"], r["t0"]) for r in parcel.by_column(rows, lambda p, z, t, td: {"n": np.full(len(p), len(p)), "t0": t[:, 0]}, 512, "n long, t0 double").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(out) == 300 and {n for n, _ in out.values()} == {2}
    assert all(t0 == 290.0 + (cell == 7) for cell, (_, t0) in out.items())


def test_parcels_of_one_start_share_their_path(monkeypatch):
    lifted, plain = [], parcel.moist_lift
    monkeypatch.setattr(ascent, "moist_lift", lambda p0, t0, p1: lifted.append(np.size(p1)) or plain(p0, t0, p1))
    n = 50
    source = ascent.Source(np.full(n, 1000.0), np.zeros(n), np.full(n, 300.0), np.full(n, 290.0))
    at = np.tile(np.append(np.arange(1000.0, 500.0, -1.0), 432.1), (n, 1))
    temperature, _ = ascent.path(source, at)
    assert sum(lifted) < 500 + n
    assert temperature[:, -1] == pytest.approx(plain(source.lcl_p, source.lcl_t, np.full(n, 432.1)))
    assert temperature[3, 400] == pytest.approx(float(plain(source.lcl_p[:1], source.lcl_t[:1], np.array([600.0]))[0]))


def test_most_unstable_levels_leave_the_expressions(spark):
    # once a struct for every step of every cell, now equal columns once, as matrices
    rows = spark.createDataFrame([(1, float(p), float(z), c + 273.15, float(rh or 50), 0.0, 0.0) for p, z, c, rh in DRY], "cell long, p double, z double, t double, rh double, u double, v double")
    out = column.most_unstable(rows)
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    got = out.first()
    assert 708 <= got["p"] <= 1008 and (1008 - got["p"]) % 1 == 0 and 0 <= got["agl"] <= 4000
