"""Record inventories: parsing index lines, windows, byte ranges and matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How a window is written, hours or days.
ACC_HOURS, ACC_DAYS = r"(?i)(\d+)\s*-\s*(\d+)\s*hour\s+acc", r"(?i)(\d+)\s*-\s*(\d+)\s*day\s+acc"
AVE_HOURS, AVE_DAYS = r"(?i)(\d+)\s*-\s*(\d+)\s*hour\s+ave", r"(?i)(\d+)\s*-\s*(\d+)\s*day\s+ave"
# Fixed value: preferred layers of a CAPE selector that names no level.
CAPE_LEVELS = r"(?i)180-0 mb above ground|surface|255-0 mb above ground"


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with record, offset, run_hour, param, level and forecast.

    A line is ``record:offset:d=YYYYMMDDHH:param:level:forecast:``; lines without
    a numeric offset or a parameter are dropped.
    """
    # the one row of an explode keeps the parts apart, else each use of a part makes and splits the line again
    rows = lines.select("*", F.explode(F.array(F.split(F.col(line), ":", -1))).alias("__part"))
    part = F.col("__part")
    at = lambda k: F.get(part, F.lit(k))
    offset = F.when(at(1).rlike(r"^\d{1,18}$"), at(1)).cast("bigint")
    rows = rows.withColumns({
        "record": at(0), "offset": offset, "run_hour": F.regexp_replace(at(2), "^d=", ""), "param": at(3), "level": at(4), "forecast": F.coalesce(at(5), F.lit("")),
    }).drop("__part")
    return rows.where(F.col("offset").isNotNull() & (F.coalesce("param", F.lit("")) != ""))


def window_bounds(text: Column, hours: str = ACC_HOURS, days: str = ACC_DAYS) -> tuple[Column, Column]:
    """(start, end) in hours of the first window that the text names, else null."""
    one = lambda pattern, k, unit: F.when(text.rlike(pattern), F.regexp_extract(text, pattern, k).cast("bigint") * unit)
    return tuple(F.coalesce(one(hours, k, 1), one(days, k, 24)) for k in (1, 2))


def with_windows(records: DataFrame, forecast: str = "forecast") -> DataFrame:
    """``records`` with start_hour, end_hour and hours of their accumulation."""
    start, end = window_bounds(F.col(forecast))
    return records.withColumns({"start_hour": start, "end_hour": end}).withColumn(
        "hours", F.when(F.col("start_hour").isNotNull(), F.greatest(F.lit(0).cast("bigint"), F.col("end_hour") - F.col("start_hour")))
    )


def byte_ranges(records: DataFrame, keys: tuple[str, ...] = ("hour",), length: Column | None = None) -> DataFrame:
    """``records`` with first_byte and last_byte.

    A record ends before the next larger offset of its file, so records that
    share an offset share a range; the last one ends with the file, where its
    length is known.
    """
    # from the end, so that the frame grows; one that shrinks is gone through anew for each record
    order = Window.partitionBy(*keys).orderBy(F.col("offset").desc()).rangeBetween(Window.unboundedPreceding, -1)
    end = F.coalesce(F.min("offset").over(order), length if length is not None else F.lit(None).cast("bigint"))
    return records.withColumns({"first_byte": F.col("offset"), "last_byte": end - 1})


def range_header(first: Column, last: Column) -> Column:
    return F.concat_ws("", F.lit("bytes="), first.cast("string"), F.lit("-"), F.coalesce(last.cast("string"), F.lit("")))


def dotted(record: Column) -> Column:
    """Order of dotted record numbers: part by part, a missing part first."""
    return F.transform(F.split(record, r"\."), lambda x: x.cast("bigint"))


def matches() -> Column:
    """Whether a record (param, level) fits a selector (s_param, s_level, level_regex)."""
    return (
        (F.col("param") == F.col("s_param"))
        & (F.col("s_level").isNull() | (F.col("level") == F.col("s_level")))
        & (F.col("level_regex").isNull() | F.expr("level rlike level_regex"))
    )


def first_match(records: DataFrame, selectors: DataFrame, keys: tuple[str, ...] = ("hour",)) -> DataFrame:
    """For each file and selector the first matching record, by ordinal.

    selectors: selector, param, level, level_regex (either may be null). A level
    is matched exactly, a pattern by search; a CAPE selector with neither
    prefers certain layers. The selectors, a catalogue, join by parameter.
    """
    chosen = selectors.select("selector", F.col("param").alias("s_param"), F.col("level").alias("s_level"), "level_regex")
    plain = (F.col("param") == "CAPE") & F.col("s_level").isNull() & F.col("level_regex").isNull()
    rank = F.when(plain & ~F.col("level").rlike(CAPE_LEVELS), 1).otherwise(0)
    place = F.coalesce(F.col("ordinal").cast("bigint"), F.lit(-(1 << 63)))  # a missing one first
    found = records.join(F.broadcast(chosen), matches()).select(*records.columns, "selector", rank.alias("rank"), place.alias("place"))
    # numbers alone are aggregated by hash, without a sort; whole records then meet the few winners
    group = [*keys, "selector"]
    least = found.groupBy(*group).agg(*[F.min(F.when(F.col("rank") == k, F.col("place"))).alias(f"least{k}") for k in (0, 1)])
    won = least.select(*[F.col(c).alias(f"won_{c}") for c in group], F.when(F.col("least0").isNull(), 1).otherwise(0).alias("won_rank"), F.coalesce("least0", "least1").alias("won_place"))
    same = [F.col(c).eqNullSafe(F.col(f"won_{c}")) for c in group] + [F.col("rank") == F.col("won_rank"), F.col("place") == F.col("won_place")]
    rest = [c for c in records.columns if c not in keys]
    best = found.join(won.hint("shuffle_hash"), same).groupBy(*group).agg(F.min_by(F.struct(*rest), "record").alias("best"))
    return best.select(*group, "best.*")


def unique_records(records: DataFrame, keys: tuple[str, ...] = ("hour", "record"), order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """The first of records that share a number."""
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first")).select(*keys, "first.*").select(*records.columns)


def merged_records(primary: DataFrame, supplement: DataFrame, keys: tuple[str, ...] = ("hour",)) -> DataFrame:
    """Two selections in order, the first of records that agree in number, offset, parameter, level and forecast."""
    same = (*keys, "record", "offset", "param", "level", "forecast")
    both = primary.withColumn("turn", F.lit(0)).unionByName(supplement.withColumn("turn", F.lit(1)))
    return unique_records(both, same, ("turn", "ordinal"))


def same_record(left: str, right: str) -> Column:
    """Whether two aliased records agree in number, parameter, level and forecast, missing parts included."""
    parts = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in ("record", "param", "level", "forecast")]
    return parts[0] & parts[1] & parts[2] & parts[3]


def average_bounds(text: Column) -> tuple[Column, Column]:
    """(start, end) in hours of the averaging window that the text names, else null."""
    return window_bounds(text, AVE_HOURS, AVE_DAYS)


def is_surface(param: str) -> Column:
    """A record of the parameter at the surface."""
    return (F.col("param") == param) & (F.col("level") == "surface")


def is_accumulation(param: str) -> Column:
    """A surface record of the parameter over a window of some length; needs ``with_windows``."""
    return F.coalesce(is_surface(param) & (F.col("end_hour") > F.col("start_hour")), F.lit(False))


#: Records of the precipitation's phases.
PHASE_MASKS = ("CSNOW", "CRAIN", "CFRZR", "CICEP")


def longest_ending(records: DataFrame, param: str, keys: tuple[str, ...] = ("hour",), target: str = "hour") -> DataFrame:
    """keys with the accumulation of ``param`` that ends at the target hour and lasts longest; of equals the first."""
    rows = records.where(is_accumulation(param) & (F.col("end_hour") == F.col(target)))
    rest = [c for c in records.columns if c not in keys]
    order = F.struct((F.col("start_hour") - F.col("end_hour")).alias("d"), "ordinal")
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("best")).select(*keys, "best.*")


def exact_masks(records: DataFrame, keys: tuple[str, ...] = ("hour",)) -> DataFrame:
    """keys, start_hour, end_hour of the windows over which all four phases are averaged."""
    start, end = average_bounds(F.col("forecast"))
    rows = records.where(F.col("param").isin(*PHASE_MASKS) & (F.col("level") == "surface")).select(*keys, "param", start.alias("start_hour"), end.alias("end_hour"))
    return rows.where("end_hour > start_hour").groupBy(*keys, "start_hour", "end_hour").agg(F.count_distinct("param").alias("n")).where(F.col("n") == len(PHASE_MASKS)).drop("n")


def masked_candidates(records: DataFrame, keys: tuple[str, ...] = ("hour",)) -> DataFrame:
    """keys, start_hour, end_hour, exact: precipitation windows whose phase is known.

    Known from averages over the same window (exact), or else from one record of
    each of the four phases. records: with windows.
    """
    windows = records.where(is_accumulation("APCP")).select(*keys, "start_hour", "end_hour").distinct()
    exact = exact_masks(records, keys).withColumn("exact", F.lit(True))
    now = records.where(F.col("param").isin(*PHASE_MASKS) & (F.col("level") == "surface")).groupBy(*keys).agg((F.count_distinct("param") == len(PHASE_MASKS)).alias("now"))
    rows = windows.join(exact, [*keys, "start_hour", "end_hour"], "left").join(now, list(keys), "left")
    return rows.withColumn("exact", F.coalesce("exact", F.lit(False))).where("exact OR now").drop("now")


def profile_complete(records: DataFrame, variables: list[str], levels: list[int], complete: bool, keys: tuple[str, ...] = ("hour",)) -> DataFrame:
    """keys, ok: whether a file has the variables at pressure levels: at all of them, or each at one at least."""
    names = [f"{x} mb" for x in levels]
    held = records.where(F.col("param").isin(variables) & F.col("level").isin(names)).groupBy(*keys, "param").agg(F.count_distinct("level").alias("n"))
    least = len(levels) if complete else 1
    ok = held.groupBy(*keys).agg((F.count_if(F.col("n") >= least) == len(variables)).alias("ok"))
    return records.select(*keys).distinct().join(ok, list(keys), "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def profile_levels(records: DataFrame, variables: list[str], levels: list[int], keys: tuple[str, ...] = ("hour",)) -> DataFrame:
    """keys, level, variables: the pressure levels at which a file has any of the variables, and how many."""
    names = [f"{x} mb" for x in levels]
    held = records.where(F.col("param").isin(variables) & F.col("level").isin(names))
    return held.groupBy(*keys, F.regexp_extract("level", r"^(\d+)", 1).cast("int").alias("pressure")).agg(F.count_distinct("param").cast("int").alias("variables"))
