"""Accumulations over forecast hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nimbostrat.functions.missing import floor_at, poison_sum

CELL = ("model", "cell")


def _upto(keys: tuple[str, ...], order: str = "hour") -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def run_max(fields: DataFrame, keys: tuple[str, ...] = CELL, value: str = "value", factor: float = 1.0) -> DataFrame:
    """Maximum since the run began; missing hours are skipped (carry), none yet is missing."""
    return fields.withColumn("run_max", F.max(floor_at(F.col(value) * factor, 0.0)).over(_upto(keys)))


def cumulative(fields: DataFrame, keys: tuple[str, ...] = CELL, value: str = "value") -> DataFrame:
    """Sum since the run began; once an hour is missing all later sums are (poison)."""
    window = _upto(keys)
    whole = F.count(value).over(window) == F.count(F.lit(1)).over(window)
    return fields.withColumn("total", F.when(whole, F.sum(value).over(window)))


def weighted_sum(terms: DataFrame, keys: tuple[str, ...], value: str = "value", weight: str = "weight") -> DataFrame:
    """max(0, sum of weight * value) by key; a missing term makes it missing."""
    return terms.groupBy(*keys).agg(floor_at(poison_sum(F.col(value), F.col(weight)), 0.0).alias("total"))


def merge_terms(terms: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Terms of one source added up; those that cancel are dropped."""
    return terms.groupBy(*keys).agg(F.sum("weight").alias("weight")).where(F.abs("weight") > 1e-9)


def rolling_difference(totals: DataFrame, hours: int, keys: tuple[str, ...] = CELL, value: str = "total") -> DataFrame:
    """total(h) - total(h - hours), at least 0; at or before the window's length the total itself."""
    then = Window.partitionBy(*keys).orderBy("hour").rangeBetween(-hours, -hours)
    before = F.when(F.count(F.lit(1)).over(then) > 0, F.max(value).over(then))
    amount = F.when(F.col("hour") <= hours, F.col(value)).otherwise(F.col(value) - before)
    return totals.withColumn("rolling", floor_at(amount, 0.0))


def phase_fraction(masks: list[Column], phase: Column) -> Column:
    """Share of one phase from a single sample; all masks must be known."""
    total = sum(masks[1:], masks[0])
    return F.when(total.isNotNull(), F.when(total > 0, F.least(F.lit(1.0), floor_at(phase, 0.0) / total)).otherwise(0.0))


def sampled_phase_fraction(samples: DataFrame, keys: tuple[str, ...], masks: list[str], phase: str) -> DataFrame:
    """Mean share over the complete samples; missing if none is (renormalise)."""
    share = phase_fraction([F.col(m) for m in masks], F.col(phase))
    return samples.groupBy(*keys).agg(F.avg(share).alias("fraction"))


def previous_source_hour(hours: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """``hours`` with previous_hour: the greatest earlier hour above 0 that a run maximum goes on from."""
    order = Window.partitionBy(*keys).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    return hours.withColumn("previous_hour", F.max(F.when(F.col("hour") > 0, F.col("hour"))).over(order))


def delta_accumulation(deltas: DataFrame, steps: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """keys, hour, total: amounts of steps added up along the chain of the hours they go on from.

    deltas: keys, hour, value (the amount since the step's start, missing where
    unresolved); steps: model, hour, start_hour, whose chains begin at hour 0. Along
    one chain hours ascend, so its sum is a window; an unknown amount makes all
    later totals unknown.
    """
    chained = deltas.join(F.broadcast(steps.select("model", "hour", "start_hour")), ["model", "hour"])
    order = Window.partitionBy(*keys).orderBy("hour")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    linked = (F.lag("hour", 1, 0).over(order) == F.col("start_hour")) & F.col("value").isNotNull()
    rows = chained.withColumn("whole", linked).withColumn("known", F.min(F.col("whole").cast("int")).over(upto))
    return rows.withColumn("total", F.when(F.col("known") == 1, F.sum("value").over(upto))).select(*keys, "hour", "total")


def visible(fields: DataFrame, threshold: float, keys: tuple[str, ...], value: str = "value") -> DataFrame:
    """keys, any_finite, above: whether a grid has values, and any beyond the threshold it is shown for."""
    return fields.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col(value).isNotNull()), F.lit(False)).alias("any_finite"), F.coalesce(F.bool_or(F.col(value) > threshold), F.lit(False)).alias("above"))


def zero_where_known(value: Column) -> Column:
    """0 where there is a value, else missing."""
    return F.when(value.isNotNull(), 0.0)
