"""Run maxima of hours that arrive one by one.

The batch operator is a window over a run; here each cell's maximum is state
that later hours of the run only raise, so rows can come in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly_maxima(events: DataFrame, keys: tuple[str, ...], late: str = "2 hours") -> DataFrame:
    """Maxima by hour of event time; ``ts`` may be late by the watermark."""
    return events.withWatermark("ts", late).groupBy(*keys, F.window("ts", "1 hour").alias("w")).agg(F.max("value").alias("value")).select(*keys, F.col("w.start").alias("hour"), "value")


def running_maxima(fields: DataFrame) -> DataFrame:
    """cell, hours, run_max so far, whenever a cell gets new rows; fields: cell, value.

    State is two numbers a cell. Missing values count as hours but raise nothing.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hours, most = state.get if state.exists else (0, None)
        for part in parts:
            known = part["value"].dropna()
            hours += len(part)
            if len(known):
                high = max(0.0, float(known.max()))
                most = high if most is None else max(most, high)
        state.update((hours, most))
        yield pd.DataFrame({"cell": [key[0]], "hours": [hours], "run_max": [most]})

    return fields.groupBy("cell").applyInPandasWithState(
        update, "cell bigint, hours bigint, run_max double", "hours bigint, run_max double", "update", GroupStateTimeout.NoTimeout
    )
