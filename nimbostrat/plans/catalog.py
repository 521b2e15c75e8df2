"""The catalogue of products: how each is made from a record or other fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbostrat.functions import units
from nimbostrat.sources.inventory import is_accumulation, masked_candidates, with_windows

# Direct products. key, unit, param, level, level pattern, transform, models (none: all).
WHOLE = "(?i)entire atmosphere"
SCALARS = [
    ("temperature", "F", "TMP", "2 m above ground", None, "kelvinToFahrenheit", []),
    ("dewpoint2m", "F", "DPT", "2 m above ground", None, "kelvinToFahrenheit", []),
    ("humidity2m", "%", "RH", "2 m above ground", None, None, []),
    ("visibility", "mi", "VIS", "surface", None, "metersToMiles", []),
    ("gust", "mph", "GUST", "surface", None, "metersPerSecondToMph", []),
    ("reflectivityComposite", "dBZ", "REFC", None, WHOLE, None, []),
    ("reflectivity1km", "dBZ", "REFD", "1000 m above ground", None, None, []),
    ("cloudCover", "%", "TCDC", None, WHOLE, None, []),
    ("cloudCeiling", "ft", "HGT", "cloud ceiling", None, "metersToFeet", ["gfs", "nam3km", "hrrr"]),
    ("wetBulbZeroHeight", "ft", "HGT", "lowest level of the wet bulb zero", None, "metersToFeet", []),
    ("sbcape", "J/kg", "CAPE", "surface", None, None, ["gfs", "nam3km", "hrrr"]),
    ("sbcin", "J/kg", "CIN", "surface", None, None, ["gfs", "nam3km", "hrrr"]),
    ("mlcape", "J/kg", "CAPE", "90-0 mb above ground", None, None, ["gfs", "nam3km", "hrrr"]),
    ("mlcin", "J/kg", "CIN", "90-0 mb above ground", None, None, ["gfs", "nam3km", "hrrr"]),
    ("mucape", "J/kg", "CAPE", "255-0 mb above ground", None, None, ["gfs", "nam3km", "hrrr"]),
    ("srh0to3km", "m2/s2", "HLCY", "3000-0 m above ground", None, None, []),
    ("srh0to1km", "m2/s2", "HLCY", "1000-0 m above ground", None, None, ["nam3km", "hrrr"]),
    ("updraftHelicity2to5km1h", "m2/s2", "MXUPHL", "5000-2000 m above ground", None, None, ["nam3km", "hrrr"]),
    ("maxSimulatedHailSize", "in", "HAIL", None, WHOLE, "metersToInches", ["hrrr"]),
    ("pwat", "mm", "PWAT", None, WHOLE, None, []),
    ("pblHeight", "m", "HPBL", "surface", None, None, []),
    ("snowDepth", "in", "SNOD", "surface", None, "metersToInches", []),
    ("snowWaterEq", "in", "WEASD", "surface", None, "kgM2ToWaterInches", []),
    ("snowHrrrAsnow", "in", "ASNOW", "surface", None, "metersToInches", ["hrrr"]),
]
# Contour steps in decametres by level; wind levels; derived products and
# the required (param, level) of each, then the groups of which one record is enough.
CONTOUR_STEPS = {850: 3, 700: 3, 500: 6, 300: 12, 250: 12}
SURFACE = [("TMP", "2 m above ground")]
MASKS = [("CRAIN", "surface"), ("CSNOW", "surface"), ("CFRZR", "surface"), ("CICEP", "surface")]
MOISTURE = [("DPT", "2 m above ground"), ("RH", "2 m above ground")]
PRESSURE = [("PRES", "surface"), ("PRMSL", "mean sea level")]
WIND10 = [("UGRD", "10 m above ground"), ("VGRD", "10 m above ground")]
HEIGHT = ("HGT", "surface")
DERIVED = [
    ("precipRateAndType", "in/hr", [("PRATE", "surface"), *MASKS], []),
    ("reflectivity1kmPrecipType", "dBZ", [("REFD", "1000 m above ground"), *MASKS], []),
    ("surfaceBasedLclHeight", "m", SURFACE, [MOISTURE]),
    ("freezingRainLiquidTotal", "in", [], []),
    ("surfaceThetaE", "K", SURFACE, [MOISTURE, PRESSURE]),
    ("lapseRate700to500", "C/km", [("TMP", "700 mb"), ("TMP", "500 mb"), ("HGT", "700 mb"), ("HGT", "500 mb")], []),
    ("lapseRate0to3km", "C/km", [HEIGHT], []),
    ("bulkShear0to6km", "kt", [HEIGHT], []),
    ("effectiveBulkShear", "kt", [HEIGHT], [[("CAPE", "90-0 mb above ground"), ("CAPE", "surface")], [("CIN", "90-0 mb above ground"), ("CIN", "surface")]]),
    ("supercellCompositeParameter", "", [HEIGHT, ("CAPE", "255-0 mb above ground"), ("HLCY", "3000-0 m above ground")], []),
    ("effectiveLayerSupercellCompositeParameter", "", [HEIGHT, ("CAPE", "255-0 mb above ground"), *SURFACE], [MOISTURE]),
    ("significantTornadoParameter", "", [HEIGHT, ("CAPE", "surface"), ("HLCY", "1000-0 m above ground")], []),
    ("effectiveLayerSignificantTornadoParameter", "", [HEIGHT, ("CAPE", "90-0 mb above ground"), ("CIN", "90-0 mb above ground"), *SURFACE], [MOISTURE]),
    ("dcape", "J/kg", SURFACE, [MOISTURE]),
    ("frontogenesis850", "C/100km/3hr", [("TMP", "850 mb"), ("UGRD", "850 mb"), ("VGRD", "850 mb")], []),
    ("frontogenesis700", "C/100km/3hr", [("TMP", "700 mb"), ("UGRD", "700 mb"), ("VGRD", "700 mb")], []),
    ("relativeVorticity700", "x10^-5 s^-1", [("ABSV", "700 mb")], []),
    ("relativeVorticity500", "x10^-5 s^-1", [("ABSV", "500 mb")], []),
    ("gustRunMax", "mph", [("GUST", "surface")], []),
    ("updraftHelicity2to5kmRunMax", "m2/s2", [("MXUPHL", "5000-2000 m above ground")], []),
    ("framFlatIce", "in", [*SURFACE, *WIND10], [MOISTURE]),
    ("framRadialIce", "in", [*SURFACE, *WIND10], [MOISTURE]),
    ("snow10to1", "in", [], []),
    ("snowKuchera", "in", [], []),
    ("snowCobb", "in", [], []),
    ("snowRfConus", "in", [HEIGHT], []),
    ("snowWesternLinear", "in", [HEIGHT], []),
]
# Models of derived products that not all have; a record that serves directly; the
# liquid a product accumulates; the profile it needs (variables, levels, all of them or one each).
DERIVED_MODELS = {"precipRateAndType": ["gfs", "nam3km", "hrrr"], "snowWesternLinear": ["hrrr"]}
DIRECT = {"surfaceBasedLclHeight": ("HGT", "level of adiabatic condensation from sfc")}
LIQUID = {"freezingRainLiquidTotal": "ice", "framFlatIce": "ice", "framRadialIce": "ice", **dict.fromkeys(("snow10to1", "snowKuchera", "snowCobb", "snowRfConus", "snowWesternLinear"), "snow")}
REDUCED, SNOW_LEVELS = [1000, 925, 850, 700, 500, 300], list(range(1000, 299, -25))
EFFECTIVE = [x for x in SNOW_LEVELS if x >= 700 or x % 50 == 0]
WHOLE_COLUMN = ["HGT", "TMP", "RH", "UGRD", "VGRD"]
PROFILES = {
    "lapseRate0to3km": (["TMP", "HGT"], REDUCED, True),
    "bulkShear0to6km": (["HGT", "UGRD", "VGRD"], REDUCED, True),
    "effectiveBulkShear": (["HGT", "UGRD", "VGRD"], REDUCED, True),
    "supercellCompositeParameter": (WHOLE_COLUMN, REDUCED, True),
    "significantTornadoParameter": (WHOLE_COLUMN, REDUCED, True),
    "effectiveLayerSupercellCompositeParameter": (WHOLE_COLUMN, EFFECTIVE, True),
    "effectiveLayerSignificantTornadoParameter": (WHOLE_COLUMN, EFFECTIVE, True),
    "dcape": (["TMP", "HGT", "RH"], REDUCED, False),
    "snowKuchera": (["TMP", "HGT"], [x for x in SNOW_LEVELS if x >= 500], True),
    "snowCobb": (["TMP", "HGT", "RH", "VVEL"], [x for x in SNOW_LEVELS if x <= 925], True),
    "snowRfConus": (WHOLE_COLUMN, SNOW_LEVELS, True),
    "snowWesternLinear": (["TMP", "HGT", "UGRD", "VGRD"], SNOW_LEVELS, True),
}
SCHEMA = "entry string, kind string, unit string, transform string, models array<string>, selector string, param string, level string, level_regex string, required boolean, any_group int"


def _rows() -> list[tuple]:
    rows = [(k, "scalar", unit, t, models, f"{k}:0", p, lev, pattern, True, None) for k, unit, p, lev, pattern, t, models in SCALARS]
    for key, level in [("wind", "10 m above ground"), ("wind80m", "80 m above ground"), *[(f"wind{x}", f"{x} mb") for x in CONTOUR_STEPS]]:
        unit, t = ("mph", "metersPerSecondToMph") if level.endswith("ground") else ("kt", "metersPerSecondToKnots")
        rows += [(key, "wind", unit, t, [], f"{key}:{p}", p, level, None, True, None) for p in ("UGRD", "VGRD")]
    for key in ("precip", "precip3h", "precip6h", "precip12h", "precip24h", "precipTotal"):
        rows.append((key, "precipAccumulation", "in", "kgM2ToWaterInches", [], f"{key}:0", "APCP", "surface", None, True, None))
    for level in CONTOUR_STEPS:
        rows.append((f"height{level}", "heightContour", "dam", "metersToDam", [], f"height{level}:0", "HGT", f"{level} mb", None, True, None))
        if level >= 500:
            rows.append((f"temp{level}", "scalar", "C", "kelvinToCelsius", [], f"temp{level}:0", "TMP", f"{level} mb", None, True, None))
            rows.append((f"rh{level}", "scalar", "%", None, [], f"rh{level}:0", "RH", f"{level} mb", None, True, None))
        if level in (500, 700):
            rows.append((f"absoluteVorticity{level}", "scalar", "x10^-5 s^-1", "absoluteVorticity1e5", [], f"absoluteVorticity{level}:0", "ABSV", f"{level} mb", None, True, None))
            rows.append((f"verticalVelocity{level}", "scalar", "dPa/s", "paSToDPaS", [], f"verticalVelocity{level}:0", "VVEL", f"{level} mb", None, True, None))
    for key, unit, required, groups in DERIVED:
        models = DERIVED_MODELS.get(key, [])
        rows += [(key, "derived", unit, None, models, f"{key}:{n}", p, lev, None, True, None) for n, (p, lev) in enumerate(required)]
        rows += [(key, "derived", unit, None, models, f"{key}:{g}.{n}", p, lev, None, False, g) for g, group in enumerate(groups) for n, (p, lev) in enumerate(group)]
        variables, levels, whole = PROFILES.get(key, ([], [], True))
        rows += [(key, "derived", unit, None, models, f"{key}:{v}{x}", v, f"{x} mb", None, whole, None if whole else 100 + k) for k, v in enumerate(variables) for x in levels]
        if not required and not groups and not variables:  # liquid alone
            rows.append((key, "derived", unit, None, models, f"{key}:liquid", "APCP", "surface", None, False, None))
    return rows


def requirements() -> list[dict]:
    """Each entry's records as one row: need, groups (one of each), direct, liquid, models.

    A record is written ``param:level``, and ``param:~`` where the level is matched by a pattern.
    """
    out: dict[str, dict] = {}
    for entry, kind, _, _, models, _, p, level, pattern, required, group in _rows():
        row = out.setdefault(entry, {"entry": entry, "kind": kind, "need": [], "groups": {}, "direct": None, "liquid": LIQUID.get(entry), "models": models})
        name = f"{p}:~" if pattern else f"{p}:{level}"
        if group is not None:
            row["groups"].setdefault(group, []).append(name)
        elif required:
            row["need"].append(name)
    for entry, (p, level) in DIRECT.items():
        out[entry]["direct"] = f"{p}:{level}"
    return [{**r, "groups": [r["groups"][g] for g in sorted(r["groups"])]} for r in out.values()]


REQUIREMENT_SCHEMA = "entry string, kind string, need array<string>, groups array<array<string>>, direct string, liquid string, models array<string>"


def catalog(spark: SparkSession) -> DataFrame:
    """One row for each selector of each product."""
    return spark.createDataFrame(_rows(), SCHEMA)


def for_model(entries: DataFrame, model: str) -> DataFrame:
    """Entries that a model may have."""
    return entries.where((F.size("models") == 0) | F.array_contains("models", model))


def liquid_sources(records: DataFrame, keys: tuple[str, ...] = ("hour",), target: str = "hour") -> DataFrame:
    """keys, snow, ice: whether a file can give accumulated liquid of either phase; records: with windows.

    Snow from an accumulation of snow water, ice from one of freezing rain that ends
    at the target hour, both from precipitation whose phases are known.
    """
    masked = masked_candidates(records, keys).select(*keys).distinct().withColumn("masked", F.lit(True))
    own = records.groupBy(*keys).agg(
        F.coalesce(F.bool_or(is_accumulation("WEASD")), F.lit(False)).alias("weasd"), F.coalesce(F.bool_or(is_accumulation("FRZR") & (F.col("end_hour") == F.col(target))), F.lit(False)).alias("frzr")
    )
    rows, known = own.join(masked, list(keys), "left"), F.coalesce("masked", F.lit(False))
    return rows.select(*keys, (F.col("weasd") | known).alias("snow"), (F.col("frzr") | known).alias("ice"))


def products(records: DataFrame, spark: SparkSession, model: str, keys: tuple[str, ...] = ("hour",), target: str = "hour") -> DataFrame:
    """keys, entry, available: which products of a model the records of each file can make.

    An entry needs all its records and one of each group, or its direct record.
    Products that accumulate need a target hour above 0 and a source of their
    liquid. The records that the catalogue asks for are gathered in one set a file.
    """
    entries = spark.createDataFrame([r for r in requirements() if not r["models"] or model in r["models"]], REQUIREMENT_SCHEMA)
    patterns = {p for k, _, p, _, pattern, _, _ in SCALARS if pattern}
    exact = sorted({n for r in requirements() for n in [*r["need"], *[x for g in r["groups"] for x in g], r["direct"]] if n and not n.endswith(":~")})
    name = F.concat_ws(":", "param", "level")
    token = F.when(name.isin(exact), name).when(F.col("param").isin(*sorted(patterns)) & F.col("level").rlike(WHOLE), F.concat("param", F.lit(":~")))
    held = records.groupBy(*keys).agg(F.collect_set(token).alias("held")).join(liquid_sources(with_windows(records), keys, target), list(keys))
    rows = held.crossJoin(F.broadcast(entries))
    complete = (F.size(F.array_except("need", "held")) == 0) & F.forall("groups", lambda g: F.arrays_overlap(g, F.col("held")))
    liquid = F.when(F.col("liquid").isNull(), True).otherwise((F.col(target) > 0) & F.when(F.col("liquid") == "snow", F.col("snow")).otherwise(F.col("ice")))
    return rows.select(*keys, "entry", (F.coalesce(F.array_contains("held", F.col("direct")), F.lit(False)) | complete & liquid).alias("available"))


#: The parts of the catalogue that a way of rendering takes.
RUN_MAXIMA = ("gustRunMax", "updraftHelicity2to5kmRunMax")


def for_mode(entries: DataFrame, mode: str | None) -> DataFrame:
    """Entries that are rendered together: ``base``, ``snow``, ``runmax`` or all."""
    snow = F.col("entry").isin([k for k, v in LIQUID.items() if v == "snow"])
    return entries.where({"base": ~snow, "snow": snow, "runmax": F.col("entry").isin(*RUN_MAXIMA)}.get(mode, F.lit(True)))


def to_display(values: DataFrame, spark: SparkSession) -> DataFrame:
    """values (entry, value) with ``display`` in the product's unit."""
    table = catalog(spark).select("entry", "unit", "transform").distinct()
    chain = F
    for name in units.AFFINE:
        chain = chain.when(F.col("transform") == name, units.transform(F.col("value"), name))
    return values.join(F.broadcast(table), "entry").withColumn("display", chain.otherwise(F.col("value")))
