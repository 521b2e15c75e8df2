"""Sums since a run began, of hours that arrive in any order and more than once.

The batch operator is a window over a run in which a missing hour makes all later
sums missing.  As a stream, a cell's state is the next hour to fold, the sum so far,
whether it is still known, and the hours that came before their turn.  A sum is
given once, when its hour and all before it have come, so batches may be cut
anywhere; an hour that never comes holds later sums back, as unknown is not zero.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "next bigint, total double, known boolean, hours array<bigint>, amounts array<double>"


def fold(state: tuple, rows: Iterable[tuple[int, float | None]], step: int) -> tuple[tuple, list[tuple[int, float | None]]]:
    """The state after some (hour, amount) rows, and the (hour, sum) rows that are now settled.

    An hour that was folded already is a repetition and changes nothing; of
    repetitions that wait, the first stays.
    """
    following, total, known, hours, amounts = state
    waiting = dict(zip(hours, amounts, strict=True))
    for hour, amount in rows:
        if hour >= following:
            waiting.setdefault(hour, amount)
    settled = []
    while following in waiting:
        amount = waiting.pop(following)
        known = known and amount is not None
        total += amount if known else 0.0
        settled.append((following, total if known else None))
        following += step
    order = sorted(waiting)
    return (following, total, known, order, [waiting[h] for h in order]), settled


def cumulative_sums(fields: DataFrame, keys: tuple[str, ...] = ("cell",), first: int = 1, step: int = 1, resume: DataFrame | None = None) -> DataFrame:
    """keys, hour, total: each once, as soon as all hours from the first on have come.

    fields: a stream of keys, hour and value; a null value is an hour that is missing for
    good, a null hour is ignored. Hours are ``first``, ``first + step`` and so on. resume: a static
    table with one row of keys, hour and total at most for each key; sums go on from
    there, and hours up to it count as repetitions. The state holds a cell's waiting
    hours, a run's length at most; it survives with the checkpoint.
    """
    kinds = [f"{k} {fields.schema[k].dataType.simpleString()}" for k in keys]
    rows = fields.where("hour IS NOT NULL").select(*keys, F.col("hour").cast("long").alias("hour"), F.col("value").cast("double").alias("value"))
    resumes = resume is not None
    if resume is not None:
        begun = resume.select(*keys, F.col("hour").cast("long").alias("from_hour"), F.col("total").cast("double").alias("from_total"))
        rows = rows.join(begun, list(keys), "left")

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = None
        if state.exists:
            a, b, c, hours, amounts = state.get
            current = (a, b, c, list(hours), [None if x is None or x != x else x for x in amounts])
        settled = []
        for part in parts:
            if current is None:
                at, total = (part["from_hour"].iloc[0], part["from_total"].iloc[0]) if resumes else (None, None)
                unbegun = pd.isna(at)
                current = (first if unbegun else int(at) + step, 0.0 if unbegun or pd.isna(total) else float(total), bool(unbegun or not pd.isna(total)), [], [])
            amounts = [None if pd.isna(v) else float(v) for v in part["value"]]
            current, more = fold(current, zip(part["hour"].astype(int).tolist(), amounts, strict=True), step)
            settled += more
        state.update((*current[:4], [float("nan") if x is None else x for x in current[4]]))
        if settled:
            columns = {k: [v] * len(settled) for k, v in zip(keys, key, strict=True)}
            yield pd.DataFrame({**columns, "hour": [h for h, _ in settled], "total": pd.array([t for _, t in settled], dtype="Float64")})

    out = ", ".join([*kinds, "hour bigint", "total double"])
    return rows.groupBy(*keys).applyInPandasWithState(update, out, STATE, "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Take what the source has now and append the results to a table; a later call with the same checkpoint goes on."""
    query = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
