"""Effective layers and parcel integrators against plain loops and known soundings."""

import math

import numpy as np
import pytest

from nimbostrat.operators import ascent, effective, parcel

# p, z, t, rh, u, v: an unstable column with veering wind; t in kelvins.
STORM = [
    (1000, 0, 300.0, 70.0, 0.0, 0.0), (990, 100, 298.0, 70.0, 1.0, 1.0), (925, 800, 294.0, 70.0, 5.0, 2.0), (850, 1500, 288.0, 65.0, 10.0, 4.0),
    (700, 3000, 270.0, 50.0, 15.0, 5.0), (500, 5600, 250.0, 40.0, 28.0, 0.0), (300, 9000, 230.0, 30.0, 38.0, -5.0),
]
# a capped column: a warm dry layer over moist air, unstable from 850 hPa
CAPPED = [
    (1000, 0, 298.0, 60.0, 2.0, 3.0), (950, 440, 299.5, 45.0, 4.0, 5.0), (900, 920, 297.5, 50.0, 8.0, 6.0), (850, 1430, 294.5, 70.0, 11.0, 4.0), (800, 1960, 290.0, 80.0, 12.0, 3.0),
    (700, 3110, 279.5, 60.0, 14.0, 2.0), (600, 4350, 269.0, 50.0, 18.0, 1.0), (500, 5760, 256.0, 50.0, 24.0, 0.0), (400, 7450, 241.0, 40.0, 30.0, -1.0), (300, 9450, 226.0, 30.0, 35.0, -2.0), (200, 12000, 214.0, 20.0, 38.0, -2.0),
]
STABLE = [(1000, 0, 280.0, 50.0, 3.0, 0.0), (850, 1450, 283.0, 20.0, 6.0, 1.0), (700, 3000, 278.0, 20.0, 9.0, 1.0), (500, 5600, 262.0, 20.0, 15.0, 1.0), (300, 9200, 235.0, 20.0, 20.0, 1.0)]


def td(t, rh):
    g = math.log(rh / 100) + 17.625 * (t - 273.15) / (t - 273.15 + 243.04)
    return 243.04 * g / (17.625 - g) + 273.15


def matrices(*profiles):
    width = max(map(len, profiles))
    out = np.full((4, len(profiles), width), np.nan)
    for i, rows in enumerate(profiles):
        for k, (p, z, t, rh, *_) in enumerate(rows):
            out[:, i, k] = p, z - rows[0][1], t, td(t, rh)
    return out


def e_s(t):
    return 6.112 * math.exp(17.67 * (t - 273.15) / (t - 273.15 + 243.5))


def w_of(e, p):
    return 0.622 * e / (p - e)


def tv_of(t, w):
    return t * (1 + w / 0.622) / (1 + w)


def plain_segments(rows, source):
    """One parcel, layer by layer, as a loop over numbers."""
    sp, sz, st, sd = source
    lcl = 56 + 1 / (1 / (sd - 56) + math.log(st / sd) / 800)
    lcl_p, lcl_z, w0 = sp * (lcl / st) ** (1 / 0.2854), sz + (st - lcl) / 0.0098, w_of(e_s(sd), sp)
    cape = cin = 0.0
    seen, before, at, el, lfc = False, None, sz, None, None
    warm, warm_z = lcl, lcl_z
    for (p1, z1, t1, d1), (p2, z2, t2, d2) in zip(rows, rows[1:], strict=False):
        p, z = math.sqrt(p1 * p2), (z1 + z2) / 2
        if z <= sz + 1 or p > sp + 1:
            continue
        env = tv_of((t1 + t2) / 2, w_of(e_s((d1 + d2) / 2), p))
        if p >= lcl_p or z <= lcl_z:
            t = st * (p / sp) ** 0.2854
        else:
            n = max(1, math.ceil((z - warm_z) / 300))
            t = warm
            for _ in range(n):
                w = w_of(e_s(t), p)
                t -= 9.80665 * (1 + 2.5e6 * w / (287.05 * t)) / (1004.0 + 2.5e6**2 * w * 0.622 / (287.05 * t * t)) * (z - warm_z) / n
            warm, warm_z = t, z
        tv = tv_of(t, w0 if p >= lcl_p else w_of(e_s(t), p))
        b = 9.80665 * (tv - env) / env
        if b > 0 and (z >= lcl_z - 1 or p <= lcl_p + 0.1):
            if not seen:
                lfc = max(lcl_z, at + (z - at) * -before / (b - before) if before is not None and before <= 0 else lcl_z if at < lcl_z else z)
            seen, el = True, z2
            cape += b * (z2 - z1)
        elif not seen and b < 0:
            cin += b * (z2 - z1)
        elif before is not None and before > 0 >= b:
            el = at + (z - at) * before / (before - b)
        before, at = b, z
    return cape, cin, lcl_z, lfc, el


@pytest.mark.parametrize("rows", [STORM, CAPPED, STABLE], ids=["storm", "capped", "stable"])
@pytest.mark.parametrize("k", [0, 1, 3])
def test_segments_against_a_plain_loop(rows, k):
    m = matrices(STABLE, rows)
    got = ascent.segments(*m, ascent.Source(*(x[:, k] for x in m)))
    plain = [(p, z, t, td(t, rh)) for p, z, t, rh, *_ in rows]
    for name, want in zip(ascent.RESULTS, plain_segments(plain, plain[k]), strict=True):
        assert got[name][1] == pytest.approx(want if want is not None else math.nan, rel=1e-9, nan_ok=True), name


def plain_layer(rows):
    """The first run of sources that pass, and the most unstable one, as a loop."""
    plain = [(p, z, t, td(t, rh)) for p, z, t, rh, *_ in rows]
    base = top = None
    most = (-1.0, None)
    tried = None
    for row in plain:
        if row[1] > 4000 or row[0] < plain[0][0] - 300:
            break
        if tried is not None and tried - row[0] < 25:
            continue
        tried = row[0]
        cape, cin, _, _, el = plain_segments(plain, row)
        if cape > most[0]:
            most = (cape, el)
        if cape >= 100 and cin >= -250:
            base, top = (row[1] if base is None else base), row[1]
        elif base is not None:
            break
    return base, top, *most


@pytest.mark.parametrize("rows", [STORM, CAPPED, STABLE], ids=["storm", "capped", "stable"])
def test_layer_against_a_plain_search(rows):
    got = effective.inflow_layer(*matrices(rows))
    base, top, cape, el = plain_layer(rows)
    if base is None:
        assert all(np.isnan(v[0]) for v in got.values())
        return
    assert (got["base_m"][0], got["top_m"][0]) == (base, top)
    assert got["most_cape"][0] == pytest.approx(cape) and got["el_m"][0] == pytest.approx(el)


def test_integrators_agree():
    """On a fine profile in hydrostatic balance both ways give the same energy within an eighth: one moves by a lapse rate, the other by a fit."""
    fine = []
    for p in range(1000, 190, -5):
        x = [(r[0], *r[1:4]) for r in CAPPED]
        lo = min(max(i for i, r in enumerate(x) if r[0] >= p), len(x) - 2)
        hi = lo + 1
        s = 0.0 if x[lo][0] == p else (math.log(p) - math.log(x[lo][0])) / (math.log(x[hi][0]) - math.log(x[lo][0]))
        t, rh = (x[lo][i] + (x[hi][i] - x[lo][i]) * s for i in (2, 3))
        tv = tv_of(t, w_of(e_s(td(t, rh)), p))
        z = fine[-1][1] + 287.05 / 9.80665 * (tv + last) / 2 * math.log(fine[-1][0] / p) if fine else 0.0
        last = tv
        fine.append((p, z, t, rh))
    m = matrices(fine)
    for k in (0, 30):
        source = ascent.Source(*(x[:, k] for x in m))
        a, b = ascent.segments(*m, source), ascent.pressure_steps(*m, source)
        if b["cape"][0] > 50:
            assert a["cape"][0] == pytest.approx(b["cape"][0], rel=0.125)
            assert a["lfc_m"][0] == pytest.approx(b["lfc_m"][0], abs=200)
            # a parcel that is buoyant up to the top has no crossing, and so no level, by samples
            assert np.isnan(b["el_m"][0]) or a["el_m"][0] == pytest.approx(b["el_m"][0], abs=200)
        assert 0 <= b["cape_3km"][0] <= b["cape"][0]
        assert b["lcl_m"][0] == pytest.approx(a["lcl_m"][0], abs=120)
    assert ascent.pressure_steps(*matrices(STABLE), ascent.Source(*(x[:, 0] for x in matrices(STABLE))))["cape"][0] == 0


def test_steps_against_a_plain_loop():
    """Trapezoids between samples, summed one after another."""
    m = matrices(CAPPED)
    source = ascent.Source(*(x[:, 3] for x in m))
    got = ascent.pressure_steps(*m, source)
    levels = sorted({850.0, 200.0, *[float(r[0]) for r in CAPPED if r[0] <= 850], *map(float, range(200, 851)), float(source.lcl_p[0])}, reverse=True)
    cape = cin = 0.0
    seen, last = False, None
    for p in levels:
        z, t, d = (v[0, 0] for v in ascent.along_pressure(m[0], [m[1], m[2], m[3]], np.array([[p]])))
        _, tv = ascent.path(source, np.array([[p]]))
        env = tv_of(t, w_of(e_s(min(d, t)), p))
        b = 9.80665 * (tv[0, 0] - env) / env
        if last:
            work = (last[1] + b) / 2 * (z - last[0])
            if work > 0 and (p <= source.lcl_p[0] or z >= got["lcl_m"][0] - 1):
                cape, seen = cape + work, True
            elif work < 0 and not seen and p >= 500:
                cin += work
        last = (z, b)
    assert got["cape"][0] == pytest.approx(cape, rel=1e-9) and got["cin"][0] == pytest.approx(cin, rel=1e-9)


def test_trace_is_exact_at_its_ends(spark):
    out = ascent.parcel_traces(spark.createDataFrame([(1, float(p), float(z), t, rh) for p, z, t, rh, *_ in CAPPED], "cell long, p double, z double, t double, rh double")).first()
    source = ascent.Source(*(x[:, 0] for x in matrices(CAPPED)))
    assert out["p"][0] == 1000 and out["t"][0] == 298.0 and out["p"][-1] == 200
    assert out["dewpoint"][0] == pytest.approx(td(298.0, 60.0), abs=1e-6)
    at = next(k for k, p in enumerate(out["p"]) if abs(p - source.lcl_p[0]) < 1e-9)
    assert out["t"][at] == pytest.approx(source.lcl_t[0], abs=1e-9) and out["dewpoint"][at] == pytest.approx(out["t"][at], abs=0.05)
    assert all(a > b for a, b in zip(out["p"], out["p"][1:], strict=False)) and {float(r[0]) for r in CAPPED} <= set(out["p"])
    # saturated air keeps its equivalent potential temperature within the fit of both formulas
    theta = [parcel.equivalent(np.array(t), np.array(t), np.array(p)) for t, p in zip(out["t"][at:], out["p"][at:], strict=True) if p > 300]
    assert max(theta) - min(theta) < 2.0


def test_adiabats_invert_theta_e():
    t, p = np.meshgrid(np.linspace(230, 305, 40), np.array([1000.0, 850, 700, 500, 300]))
    good = parcel.vapour_pressure(t) < 0.2 * p
    back = ascent.saturated_temperature(parcel.equivalent(t, t, p), p)
    assert np.abs(back - t)[good].max() < 1e-6


PROFILE = "cell long, p double, z double, t double, rh double, u double, v double"
FIELDS = "cell long, mlcape double, mlcin double, sbcape double, sbcin double, mucape double"


def _table(spark, **profiles):
    return spark.createDataFrame([(int(c[1:]), *map(lambda x: None if x is None else float(x), r)) for c, rows in profiles.items() for r in rows], PROFILE)


def test_products_of_known_columns(spark):
    broken = [r if i != 2 else (*r[:3], None, *r[4:]) for i, r in enumerate(STORM)]
    profiles = _table(spark, c1=STORM, c2=STORM, c3=STABLE, c4=STORM[:2], c5=CAPPED, c6=broken, c7=STORM)
    fields = spark.createDataFrame([(1, 2000.0, -25.0, 1500.0, -10.0, 2500.0), (2, 0.0, -25.0, 0.0, 0.0, 50.0), (3, 500.0, None, 0.0, 0.0, 500.0), (4, 2000.0, -25.0, 1500.0, -10.0, 2500.0), (5, 1200.0, -120.0, 0.0, 0.0, 1800.0), (6, 2000.0, -25.0, 1500.0, -10.0, 2500.0)], FIELDS)
    got = {r["cell"]: r for r in effective.effective_products(profiles, fields).collect()}
    assert set(got) == {1, 3, 5, 6}  # 2 has too little CAPE, 4 too few levels, 7 no fields
    one = got[1]
    assert one["base_m"] == 0 and one["scp_effective"] > 0.1 and one["stp_effective"] > 0.1
    assert got[3]["base_m"] is None and got[3]["scp_effective"] is None and got[3]["stp_effective"] is None
    assert got[6]["scp_effective"] > 0.1  # a level without humidity still has its wind
    assert one["scp_effective"] == pytest.approx(2.5 * one["esrh"] / 50 * min(1, one["ebwd_kt"] / 1.943844 / 20), rel=1e-6)
    # helicity of a plain loop relative to the same motion
    wind = lambda h: [np.interp(h, [r[1] for r in STORM], [r[c] for r in STORM]) for c in (4, 5)]
    path = [wind(0.0), *[r[4:] for r in STORM if 0 < r[1] < max(one["top_m"], 1)], wind(max(one["top_m"], 1.0))]
    cu, cv = one["motion_u"], one["motion_v"]
    total = sum((b[0] - cu) * (a[1] - cv) - (a[0] - cu) * (b[1] - cv) for a, b in zip(path, path[1:], strict=False))
    assert one["esrh"] == pytest.approx(total, rel=1e-9)
    half = wind(0.5 * one["el_m"])
    assert one["ebwd_kt"] == pytest.approx(math.hypot(*half) * 1.943844, rel=1e-6)


def test_derived_grids_match_the_parts(spark):
    """All fields at once equal each by itself; cells outside the gate aren't searched but have the rest."""
    profiles = _table(spark, c1=STORM, c2=CAPPED, c3=STABLE, c4=STORM, c5=STORM[:2], c6=[(*STORM[0][:2], None, 70.0, 0.0, 0.0), *STORM[1:]])
    fields = spark.createDataFrame([(1, 2000.0, -25.0, 1500.0, -10.0, 2500.0), (2, 1200.0, -120.0, 0.0, 0.0, 1800.0), (3, 0.0, None, 0.0, None, 0.0), (6, 99.0, -10.0, 0.0, 0.0, 500.0)], FIELDS)
    got = {r["cell"]: r for r in effective.profile_derived_grids(profiles, fields).collect()}
    alone = {r["cell"]: r for r in effective.effective_products(profiles, fields).collect()}
    assert {c for c, r in got.items() if r["searched"]} == {1, 2, 6} == set(alone)
    for c in (1, 2, 6):
        assert got[c]["scp_effective"] == alone[c]["scp_effective"] and got[c]["stp_effective"] == alone[c]["stp_effective"]
    assert got[4]["scp_effective"] is None and got[3]["scp_effective"] is None
    assert got[1]["lapse_0_3km"] == pytest.approx((300.0 - 270.0) / 3) and got[4]["lapse_0_3km"] == got[1]["lapse_0_3km"]
    top = [np.interp(6000.0, [r[1] for r in STORM], [r[c] for r in STORM]) for c in (4, 5)]
    assert got[4]["shear_0_6km_kt"] == pytest.approx(math.hypot(*top) * 1.943844) and got[4]["shear_effective_kt"] is None
    assert got[1]["shear_effective_kt"] == got[1]["shear_0_6km_kt"] and got[6]["shear_effective_kt"] is None
    assert got[6]["lapse_0_3km"] is None and got[5]["shear_0_6km_kt"] is None
    want = parcel.downdraft_cape(*matrices(CAPPED), from_lowest=False)[0]
    assert got[2]["dcape"] == pytest.approx(want, rel=1e-9) and got[5]["dcape"] is None


@pytest.mark.parametrize(("ml", "sb", "want"), [((99, -10), (0, 0), False), ((150, -300), (0, 0), False), ((150, -10), (0, 0), True), ((0, 0), (150, -10), True), ((0, 0), (0, 0), False)])
def test_effective_shear_gate(spark, ml, sb, want):
    from pyspark.sql import functions as F

    from nimbostrat.functions.severe import effective_candidate

    assert spark.range(1).select(effective_candidate(*[F.lit(float(x)) for x in (*ml, *sb)])).first()[0] is want


def test_downdraft_without_the_ground(spark):
    """The lowest level's layer no longer competes; its theta-e only counts where it is the least."""
    dry = [(1000, 0, 308.0, 2.0, 0, 0), (950, 440, 304.0, 2.0, 0, 0), (900, 920, 299.5, 2.0, 0, 0), *CAPPED[3:]]
    both = parcel.downdraft_cape(*matrices(dry)), parcel.downdraft_cape(*matrices(dry), from_lowest=False)
    assert np.isfinite(both[1][0]) and both[0][0] != both[1][0]
    same = parcel.downdraft_cape(*matrices(CAPPED)), parcel.downdraft_cape(*matrices(CAPPED), from_lowest=False)
    assert same[0][0] == same[1][0]


def test_derived_grids_of_a_candidate_without_temperatures(spark):
    """Its winds still give a shear; what needs temperatures is missing."""
    profiles = _table(spark, c1=[(*r[:2], None, *r[3:]) for r in STORM], c2=STORM)
    fields = spark.createDataFrame([(c, 2000.0, -25.0, 1500.0, -10.0, 2500.0) for c in (1, 2)], FIELDS)
    got = {r["cell"]: r for r in effective.profile_derived_grids(profiles, fields).collect()}
    assert got[1]["searched"] and got[1]["shear_0_6km_kt"] == got[2]["shear_0_6km_kt"]
    assert all(got[1][c] is None for c in ("lapse_0_3km", "dcape", "scp_effective", "stp_effective")) and got[2]["scp_effective"] > 0.1


def test_downdraft_scores_only_candidate_layers(monkeypatch):
    """Layers of other levels, and those that end above the profile, cost nothing."""
    scored, plain = [], parcel.equivalent
    monkeypatch.setattr(parcel, "equivalent", lambda t, td, p: scored.append(len(p)) or plain(t, td, p))
    parcel.downdraft_cape(*matrices(STORM[:2], CAPPED, STORM[:3], *[STORM[:2]] * 50), from_lowest=False)
    assert sum(scored) == sum(600 <= r[0] < 1000 for r in CAPPED)


def test_derived_grids_are_one_trip_to_python(spark):
    """No step of the fields is evaluated level by level outside of it."""
    profiles, fields = _table(spark, c1=STORM), spark.createDataFrame([(1, 2000.0, -25.0, 1500.0, -10.0, 2500.0)], FIELDS)
    plan = effective.profile_derived_grids(profiles, fields)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and not any(x in plan for x in ("ArrowEvalPython", "aggregate(", "filter("))
