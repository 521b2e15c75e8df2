"""Interval planning: which accumulation intervals add up to a window.

Plans are tables of terms; the searches are recursive queries over intervals of
one model, which are few, so they run over the plan and never over cells.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def longest_tiling(intervals: DataFrame, start: int, end: int) -> DataFrame:
    """Per model the tiles from ``start`` to ``end``, longest first at each step.

    intervals: model, start_hour, end_hour. Gives model, step, start_hour,
    end_hour; nothing for a model whose greedy tiling meets a gap.
    """
    spark, name = intervals.sparkSession, f"tiles_{uuid.uuid4().hex}"
    fits = intervals.where((F.col("start_hour") >= start) & (F.col("end_hour") <= end) & (F.col("end_hour") > F.col("start_hour")))
    fits.groupBy("model", "start_hour").agg(F.max("end_hour").alias("end_hour")).createOrReplaceTempView(name)
    chain = spark.sql(
        f"""WITH RECURSIVE walk(model, step, start_hour, end_hour) AS (
            SELECT model, 1, start_hour, end_hour FROM {name} WHERE start_hour = {int(start)}
            UNION ALL
            SELECT w.model, w.step + 1, t.start_hour, t.end_hour FROM walk w JOIN {name} t ON t.model = w.model AND t.start_hour = w.end_hour
        ) SELECT * FROM walk"""
    )
    whole = chain.groupBy("model").agg(F.max("end_hour").alias("reached")).where(F.col("reached") == end).select("model")
    return chain.join(whole, "model", "left_semi")


def ranked_path(intervals: DataFrame, start: int, end: int) -> DataFrame:
    """Per model the first path from ``start`` to ``end`` by kind, then shortest tiles.

    intervals: model, kind_rank, start_hour, end_hour. At each step the lowest
    rank, then the shortest and earliest interval from which the end can still
    be reached is taken (the result of a depth-first search with backtracking).
    A model's intervals within the window, a plan of tens of rows, are folded
    twice: backwards for the hours that reach the end, then forwards.
    """
    fits = intervals.where((F.col("start_hour") >= start) & (F.col("end_hour") <= end) & (F.col("end_hour") > F.col("start_hour")))
    plans = fits.groupBy("model").agg(F.collect_set(_edge(F.col("start_hour"), F.col("kind_rank"), F.col("end_hour"))).alias("edges"))
    steps = _walk(plans, start, end).select("model", F.posexplode("path").alias("k", "x"))
    return steps.select("model", (F.col("k") + 1).alias("step"), F.col("x.r").alias("kind_rank"), F.col("x.s").alias("start_hour"), F.col("x.e").alias("end_hour"))


def _edge(start: Column, rank: Column, end: Column) -> Column:
    return F.struct(start.cast("bigint").alias("s"), rank.cast("int").alias("r"), (end - start).cast("bigint").alias("d"), end.cast("bigint").alias("e"))


def _walk(plans: DataFrame, start: int, end: int) -> DataFrame:
    """plans (an array ``edges`` a row) with ``path``: the edges of the first path from ``start`` to ``end``."""
    goal = F.array(F.lit(end).cast("bigint"))
    plans = plans.withColumn("edges", F.sort_array("edges"))
    reach = F.aggregate(F.reverse("edges"), goal, lambda acc, x: F.when(F.array_contains(acc, x["e"]), F.array_union(acc, F.array(x["s"]))).otherwise(acc))
    none = F.slice("edges", 1, 0)
    walk = F.aggregate(
        "edges",
        F.struct(F.lit(start).cast("bigint").alias("at"), none.alias("path")),
        lambda acc, x: F.when(
            (x["s"] == acc["at"]) & F.array_contains("reach", x["e"]), F.struct(x["e"].alias("at"), F.concat(acc["path"], F.array(x)).alias("path"))
        ).otherwise(acc),
        lambda acc: acc["path"],
    )
    return plans.withColumn("reach", reach).withColumn("path", walk)


def window_terms(intervals: DataFrame, hours: int | None, published: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Terms that add up to the amount of the last ``hours`` (None: since hour 0) at each published hour.

    intervals: keys, start_hour, end_hour; published: keys, hour. Gives keys,
    hour, start_hour, end_hour, weight; nothing for an hour without a plan. Three
    ways are tried in turn: an interval that fits exactly; the total since hour 0
    less the total before the window; the longest tiles that fill the window. Keys
    tell plans apart: with several runs of a model in a table, model and run. One
    plan's intervals and hours, hundreds of rows, come to one task.
    """
    spans = intervals.where((F.col("start_hour") >= 0) & (F.col("end_hour") > F.col("start_hour")))
    rows = spans.select(*keys, F.col("start_hour").cast("bigint").alias("a"), F.col("end_hour").cast("bigint").alias("b"))
    rows = rows.unionByName(published.select(*keys, F.col("hour").cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"))).distinct()
    names = [*keys, "hour", "start_hour", "end_hour", "weight"]

    def run(key: tuple, plan: pd.DataFrame) -> pd.DataFrame:
        known = plan[plan["b"].notna()]
        book = Plans(list(zip(known["a"].astype(int), known["b"].astype(int), strict=True)), set(plan.loc[plan["b"].isna(), "a"].astype(int)))
        return pd.DataFrame([(*key, h, a, b, w) for h in sorted(book.hours) for (a, b), w in book.window(h, hours).items()], columns=names)

    kinds = [f"`{k}` {intervals.schema[k].dataType.simpleString()}" for k in keys]
    return rows.groupBy(*keys).applyInPandas(run, ", ".join([*kinds, "hour bigint, start_hour bigint, end_hour bigint, weight double"]))


class Plans:
    """The totals since hour 0 of one model, each made of the one before it."""

    def __init__(self, spans: list[tuple[int, int]], hours: set[int]):
        self.spans, self.hours = {(a, b) for a, b in spans if b in hours}, hours
        self.earliest: dict[int, int] = {}
        self.ends: dict[int, list[int]] = {}
        for a, b in sorted(self.spans):
            self.earliest.setdefault(b, a)
            self.ends.setdefault(a, []).append(b)
        # hour -> the interval that ends there (its prefix is the total at its start), or tiles
        self.totals: dict[int, list[tuple[int, int]] | int | None] = {0: []}
        for h in sorted(x for x in hours if x > 0):
            start = self.earliest.get(h)
            self.totals[h] = start if start == 0 or start is not None and self.totals.get(start) is not None else self.tiles(0, h) or None

    def tiles(self, start: int, end: int) -> list[tuple[int, int]]:
        """The longest interval within the window at each step; none if there is a gap."""
        out = []
        while start < end:
            reach = max((b for b in self.ends.get(start, []) if b <= end), default=None)
            if reach is None:
                return []
            out.append((start, reach))
            start = reach
        return out

    def total(self, hour: int) -> list[tuple[int, int]]:
        """The intervals of the total at an hour, none if it has no plan."""
        out = []
        while hour > 0:
            link = self.totals.get(hour)
            if link is None:
                return []
            if isinstance(link, list):
                return link + out
            out.insert(0, (link, hour))
            hour = link
        return out

    def window(self, hour: int, length: int | None) -> dict[tuple[int, int], float]:
        if hour <= 0:
            return {}
        start = 0 if length is None else max(0, hour - length)
        if (start, hour) in self.spans:
            return {(start, hour): 1.0}
        whole, before = self.total(hour), self.total(start)
        if whole and (start == 0 or before):
            weights: dict[tuple[int, int], float] = {}
            for sign, terms in ((1.0, whole), (-1.0, before)):
                for t in terms:
                    weights[t] = weights.get(t, 0.0) + sign
            return {t: w for t, w in weights.items() if abs(w) > 1e-9}
        return dict.fromkeys(self.tiles(start, hour), 1.0)


#: Order of the ways to know an interval's liquid: differences of totals, direct records, masked precipitation.
CHUNK_RANKS = {"delta": 0, "direct": 1, "masked": 2}


def liquid_chunks(intervals: DataFrame, start: int, end: int) -> DataFrame:
    """Per model the chunks of one phase's liquid that fill a window, with their terms.

    intervals: model, kind (``direct`` or ``masked``), start_hour, end_hour. Direct
    totals since hour 0 at neighbouring hours also give a difference. Gives model,
    step, kind, start_hour, end_hour, terms: an array of (kind, start_hour,
    end_hour, weight). The path takes at each step the best kind, then the shortest
    chunk, from which the end can be reached.
    """
    kinds = list(CHUNK_RANKS)
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in CHUNK_RANKS.items() for x in pair]), F.col("kind"))
    fits = intervals.where((F.col("start_hour") >= 0) & (F.col("end_hour") <= end) & (F.col("end_hour") > F.col("start_hour")))
    plans = fits.groupBy("model").agg(F.collect_set(_edge(F.col("start_hour"), rank, F.col("end_hour"))).alias("all"))
    direct = F.filter("all", lambda x: (x["r"] == CHUNK_RANKS["direct"]) & (x["s"] == 0) & (x["e"] >= start))
    plans = plans.withColumn("totals", F.array_sort(F.transform(direct, lambda x: x["e"])))
    # a difference needs the total at its start; the window's own start needs one unless it is 0
    begun = F.array_union(F.array(F.lit(0).cast("bigint")), F.col("totals")) if start == 0 else F.when(F.array_contains("totals", start), F.col("totals")).otherwise(F.array().cast("array<bigint>"))
    plans = plans.withColumn("hours", begun)
    pairs = F.zip_with(F.slice("hours", 1, F.greatest(F.size("hours") - 1, F.lit(0))), F.slice("hours", 2, F.greatest(F.size("hours") - 1, F.lit(0))), lambda a, b: _edge(a, F.lit(CHUNK_RANKS["delta"]), b))
    plans = plans.withColumn("edges", F.concat(F.filter("all", lambda x: x["s"] >= start), pairs))
    steps = _walk(plans, start, end).select("model", F.posexplode("path").alias("k", "x"))
    term = lambda kind, a, b, w: F.struct(kind.alias("kind"), a.cast("bigint").alias("start_hour"), b.alias("end_hour"), F.lit(w).alias("weight"))
    kind, a, b, zero = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("x.r") + 1), F.col("x.s"), F.col("x.e"), F.lit(0)
    whole = term(F.lit("direct"), zero, b, 1.0)
    delta = F.when(a > 0, F.array(whole, term(F.lit("direct"), zero, a, -1.0))).otherwise(F.array(whole))
    terms = F.when(F.col("x.r") == CHUNK_RANKS["delta"], delta).otherwise(F.array(term(kind, a, b, 1.0)))
    return steps.select("model", (F.col("k") + 1).alias("step"), kind.alias("kind"), a.alias("start_hour"), b.alias("end_hour"), terms.alias("terms"))


def resume_steps(intervals: DataFrame, upto: int) -> DataFrame:
    """model, hour, start_hour: the latest earlier hour from which an accumulation goes on.

    That is the latest start with a path of intervals from it to the hour and, unless
    it is 0, one from 0 to it. Hours up to ``upto`` that no such path reaches are
    left out.
    """
    spans = intervals.where((F.col("start_hour") >= 0) & (F.col("end_hour") <= upto) & (F.col("end_hour") > F.col("start_hour")))
    spans = spans.select("model", F.col("start_hour").cast("bigint").alias("a"), F.col("end_hour").cast("bigint").alias("b")).distinct()
    # the latest start of a path to an hour is the latest start of a last interval
    known = _reached(spans).select("model", F.col("hour").alias("a"))
    return spans.join(known, ["model", "a"], "left_semi").groupBy("model", F.col("b").alias("hour")).agg(F.max("a").alias("start_hour"))


def _reached(spans: DataFrame) -> DataFrame:
    """model, hour: what intervals a, b reach from 0. A model's plan is folded in order of its starts."""
    edges = F.sort_array(F.collect_set(F.struct("a", "b")))
    hours = F.aggregate("edges", F.array(F.lit(0).cast("bigint")), lambda acc, x: F.when(F.array_contains(acc, x["a"]), F.array_union(acc, F.array(x["b"]))).otherwise(acc))
    return spans.groupBy("model").agg(edges.alias("edges")).select("model", F.explode(hours).alias("hour"))


def source_hours(published: DataFrame, targets: DataFrame, hourly_to: int | None = None, then: int = 3) -> DataFrame:
    """model, hour: hours whose records may serve a target, with hour 0, the target and what is published.

    targets: model, target. Every hour up to ``hourly_to`` (None: always), then
    every ``then`` hours.
    """
    zero, target = F.lit(0).cast("bigint"), F.greatest(F.col("target"), F.lit(0)).cast("bigint")
    limit = target if hourly_to is None else F.least(target, F.lit(hourly_to).cast("bigint"))
    later = F.lit((hourly_to or 0) + then).cast("bigint")
    hours = F.concat(F.sequence(zero, limit), F.when(target >= later, F.sequence(later, target, F.lit(then).cast("bigint"))).otherwise(F.array().cast("array<bigint>")) if hourly_to is not None else F.array().cast("array<bigint>"), F.array(target))
    every = targets.select("model", F.explode(hours).alias("hour"))
    return every.unionByName(published.where("hour >= 0").select("model", F.col("hour").cast("bigint").alias("hour"))).distinct()
