"""Missing values: null is unknown, and unknown is never zero.

Three rules combine them: *poison* (any missing input makes the result missing),
*carry* (missing inputs are skipped) and *renormalise* (weights of the present
inputs are scaled to their sum).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL = 1e19  # magnitudes from here on mark undefined grid points


def known(value: Column) -> Column:
    """The value where it is finite and below the sentinel, else null."""
    value = value.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < SENTINEL), value)


def floor_at(value: Column, low) -> Column:
    """max(low, value) that keeps missing values."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(low)))


def clamp(value: Column, low, high) -> Column:
    """The value within [low, high]; missing stays missing."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounds halves towards positive infinity."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / scale


def poison_sum(value: Column, weight: Column | None = None) -> Column:
    """Aggregate: the weighted sum, null if any value is missing."""
    term = value if weight is None else value * weight
    return F.when(F.count(term) == F.count(F.lit(1)), F.sum(term))


def renormalised(value: Column, weight: Column) -> Column:
    """Aggregate: the weighted mean of the present values, null without any."""
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))
