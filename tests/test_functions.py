"""Published values and the rules for missing values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbostrat.functions import severe, thermo, units, winter
from nimbostrat.functions.mercator import CONUS, latitude_row, row_latitude
from nimbostrat.functions.missing import clamp, floor_at, half_up, known, poison_sum, renormalised
from nimbostrat.operators import accumulate, parcel, render


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


L = lambda x: F.lit(x).cast("double")


def test_missing_stays_missing(spark):
    null = L(None)
    assert value(spark, floor_at(null, 0.0)) is None and value(spark, clamp(null, 0.0, 1.0)) is None
    assert value(spark, known(L(1e20))) is None and value(spark, known(L(float("nan")))) is None and value(spark, known(L(-5.0))) == -5.0
    assert value(spark, half_up(L(-2.5))) == -2 and value(spark, half_up(L(2.25), 1)) == pytest.approx(2.3)
    rows = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "v double, w double")
    assert rows.agg(poison_sum(F.col("v"), F.col("w")).alias("x")).first()["x"] is None
    assert rows.agg(renormalised(F.col("v"), F.col("w")).alias("x")).first()["x"] == 1.0


def test_thermodynamics(spark):
    assert value(spark, thermo.theta_e(L(303.15), L(293.15), L(1000.0))) == pytest.approx(349.87, abs=0.05)
    assert value(spark, thermo.theta_e(L(303.15), L(293.15), L(90.0))) is None
    assert value(spark, thermo.mixing_ratio(L(1000.0), L(900.0))) is None
    assert value(spark, thermo.dewpoint_from_rh(L(293.15), L(100.0))) == pytest.approx(293.15)
    assert value(spark, thermo.dewpoint_from_rh(L(293.15), L(0.0))) is None
    assert value(spark, thermo.dewpoint_from_vapour_pressure(thermo.vapour_pressure(L(285.0)))) == pytest.approx(285.0)


def test_composites(spark):
    kt = units.MPS_TO_KT
    assert value(spark, severe.supercell_composite(L(2000.0), L(100.0), L(30 * kt))) == pytest.approx(4)
    assert value(spark, severe.tornado_parameter(L(3000.0), L(150.0), L(750.0), L(25.0))) == pytest.approx(1.2861111)
    assert value(spark, severe.supercell_composite(L(None), L(100.0), L(60.0))) is None
    assert value(spark, severe.effective_candidate(L(None), L(-10.0), L(150.0), L(-200.0))) is True
    assert value(spark, severe.hazard_signal(*[L(None)] * 6)) == "NONE"


def test_winter(spark):
    assert [value(spark, winter.kuchera_ratio(L(float(t)))) for t in (-12, -1, 5)] == [22, 10, 3]
    assert value(spark, winter.ice_liquid_ratio(L(0.05), L(-2.0), L(10.0))) == pytest.approx(0.76180484)
    assert value(spark, winter.ice_liquid_ratio(L(0.0), L(-2.0), L(10.0))) is None
    assert value(spark, winter.cobb_ratio_at(L(-30.0))) == 8 and value(spark, winter.cobb_ratio_at(L(1.0))) is None and value(spark, winter.cobb_ratio_at(L(4.0))) == 0
    assert value(spark, winter.precip_type(L(1.0), L(1.0), L(0.0), L(0.5))) == "sleet"


def test_mercator_and_codes(spark):
    assert value(spark, row_latitude(L(0.0), 980, CONUS)) == pytest.approx(53) and value(spark, row_latitude(L(979.0), 980, CONUS)) == pytest.approx(21)
    assert value(spark, latitude_row(row_latitude(L(321.0), 980, CONUS), 980, CONUS)) == pytest.approx(321)
    assert value(spark, units.quantise(L(None), L(0.1))) == -32768 and value(spark, units.quantise(L(1e9), L(0.1))) == 32767
    assert value(spark, units.quantise(L(-0.25), L(0.1))) == -2
    assert value(spark, render.quantised(L(None), L(0.1))) == -32768 and value(spark, render.quantised_wind(L(1.0), L(None), L(0.1))) == -32768
    assert value(spark, render.quantised(L(1e9), L(0.1))) == 32767 and value(spark, render.quantised(L(-1e9), L(0.1))) == -32767
    assert value(spark, units.dequantise(F.lit(-32768), L(0.1))) is None
    assert value(spark, units.wind_direction(L(0.0), L(-1.0))) == pytest.approx(0)


def test_accumulations(spark):
    rows = [("m", 1, h, v) for h, v in enumerate([1.0, None, 3.0, 2.0])]
    fields = spark.createDataFrame(rows, "model string, cell int, hour int, value double")
    assert [r["run_max"] for r in accumulate.run_max(fields).orderBy("hour").collect()] == [1, 1, 3, 3]
    assert [r["total"] for r in accumulate.cumulative(fields).orderBy("hour").collect()] == [1, None, None, None]
    terms = spark.createDataFrame([("a", 2.0, 0.5), ("a", 1.0, -0.5), ("b", None, 1.0), ("c", 1.0, -1.0)], "k string, value double, weight double")
    assert {r["k"]: r["total"] for r in accumulate.weighted_sum(terms, ("k",)).collect()} == {"a": 0.5, "b": None, "c": 0.0}


def test_parcels():
    z = np.array([[0, 500, 1500, 3000, 5600, 9200, 11800.0]])
    p = 1013.25 * (1 - z / 44330) ** 5.255
    warm = np.array([[303, 298, 290, 279, 258, 230, 218.0]])
    cape, cin = parcel.cape_cin(p, z, warm, warm - 4)
    dry, _ = parcel.cape_cin(p, z, warm, warm - 35)
    assert cape[0] > 500 > dry[0] and cin[0] <= 0
    assert 0 < parcel.downdraft_cape(p, z, warm, warm - 20)[0] < 4000
    assert parcel.moist_move(np.array([290.0]), np.array([0.0]), np.array([1000.0]), np.array([900.0]))[0] == pytest.approx(285.5, abs=1)


def test_saturated_lift():
    lifted = parcel.moist_lift(np.array([1000.0, 850.0]), np.array([293.15, 280.0]), np.array([700.0, 850.0]))
    assert lifted[0] == pytest.approx(279.7, abs=1.0) and lifted[1] == pytest.approx(280.0, abs=0.2)
    wet = parcel.wet_bulb(np.array([300.0, 290.0]), np.array([280.0, 290.0]), np.array([950.0, 950.0]))
    assert 280 < wet[0] < 300 and wet[1] == pytest.approx(290.0, abs=0.3)


def test_effective_layer_and_models(spark):
    from nimbostrat.operators import forest

    z = np.array([[0, 300, 800, 1500, 3000, 5600, 9200, 11800.0]])
    p = 1013.25 * (1 - z / 44330) ** 5.255
    t = np.array([[303, 300, 296, 290, 279, 258, 230, 218.0]])
    base, top, most = parcel.effective_layer(p, z, t, t - 4)
    assert base[0] == 0 and top[0] > 0 and most[0] > 500
    assert np.isnan(parcel.effective_layer(p, z, t, t - 40)[0][0])
    row = spark.createDataFrame([(265.12524, 252.721327, 10.260052, 18.35802)], forest.WESTERN_FEATURES)
    ratio = lambda lon, height: row.select(forest.western_ratio(L(lon), L(height)).alias("x")).first()["x"]
    assert ratio(-110.0, 2000.0) == pytest.approx(12.879740230926302) and ratio(-90.0, 2000.0) is None and ratio(-110.0, 900.0) is None
