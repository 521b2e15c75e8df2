"""Time axes, as-of lookups and run states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def axis_intersection(frames: DataFrame, models: list[str]) -> DataFrame:
    """Hours that all models have; if there are none, the first model's hours.

    Models without any frame are left out of the comparison.
    """
    held = frames.where(F.col("model").isin(models)).groupBy("hour").agg(F.collect_set("model").alias("have"))
    whole = held.agg(F.max(F.size("have")).alias("most"), F.size(F.array_distinct(F.flatten(F.collect_set("have")))).alias("n"))
    shared, first = F.size("have") == F.col("n"), F.array_contains("have", models[0])
    return held.join(F.broadcast(whole), F.when(F.col("most") == F.col("n"), shared).otherwise(first)).select("hour")


def axis_union(frames: DataFrame, models: list[str]) -> DataFrame:
    return frames.where(F.col("model").isin(models)).select("hour").distinct()


def nearest_frame(targets: DataFrame, frames: DataFrame) -> DataFrame:
    """For each target (target_id, hour) and model, the nearest frame, however far.

    Of two equally near frames the earlier is taken. The frame of each distinct
    hour is found by two windows over a model's axis and joined back to the targets.
    """
    hours = targets.select(F.col("hour").alias("target_hour")).distinct()
    models = frames.agg(F.collect_set("model").alias("models"))
    wanted = hours.crossJoin(F.broadcast(models)).select(F.explode("models").alias("model"), F.col("target_hour").alias("hour"), F.lit(None).cast("bigint").alias("frame_hour"), F.lit(True).alias("asked"))
    held = frames.select("model", F.col("hour").cast("bigint").alias("hour"), F.col("hour").cast("bigint").alias("frame_hour"), F.lit(False).alias("asked"))
    axis = Window.partitionBy("model").orderBy("hour")
    before = F.last("frame_hour", ignorenulls=True).over(axis.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("frame_hour", ignorenulls=True).over(axis.rangeBetween(0, Window.unboundedFollowing))
    placed = wanted.unionByName(held).withColumns({"before": before, "after": after}).where("asked")
    best = F.when(F.col("before").isNull() | (F.col("after") - F.col("hour") < F.col("hour") - F.col("before")), F.col("after")).otherwise(F.col("before"))
    found = placed.select(F.col("hour").alias("target_hour"), "model", best.alias("frame_hour"))
    rows = targets.select("target_id", F.col("hour").alias("target_hour")).join(found, "target_hour")
    return rows.select("target_id", "model", "target_hour", "frame_hour", (F.abs(F.col("frame_hour") - F.col("target_hour")) * 60).alias("delta_minutes"))


def forward_probe(frames: DataFrame, anchors: list[int]) -> DataFrame:
    """Per model: its first and last hour and the first hour from each anchor on."""
    spark = frames.sparkSession
    steps = spark.createDataFrame([(a,) for a in anchors], "anchor bigint")
    ends = frames.groupBy("model").agg(F.min("hour").alias("first"), F.max("hour").alias("last"))
    probes = frames.join(F.broadcast(steps), F.col("hour") >= F.col("anchor")).groupBy("model", "anchor").agg(F.min("hour").alias("hour"))
    return ends.select("model", F.explode(F.array("first", "last")).alias("hour")).unionByName(probes.select("model", "hour")).distinct()


def published_prefix(wanted: DataFrame, published: DataFrame) -> DataFrame:
    """The wanted (model, hour) up to the first one that isn't published."""
    seen = wanted.join(published.select("model", "hour", F.lit(1).alias("there")), ["model", "hour"], "left")
    upto = Window.partitionBy("model").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return seen.withColumn("whole", F.min(F.coalesce("there", F.lit(0))).over(upto)).where("whole = 1").select("model", "hour")


def next_with_wrap(frames: DataFrame) -> DataFrame:
    """The following hour on each model's axis; after the last comes the first."""
    axis = Window.partitionBy("model").orderBy("hour")
    whole = axis.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return frames.withColumn("next_hour", F.coalesce(F.lead("hour").over(axis), F.first("hour").over(whole)))


def overlap_status(frames: DataFrame, models: list[str]) -> DataFrame:
    """Per hour: how many models have it, as ``all``, ``some`` or ``one``."""
    n = F.count_distinct("model")
    status = F.when(n == len(models), "all").when(n > 1, "some").otherwise("one")
    return frames.where(F.col("model").isin(models)).groupBy("hour").agg(n.alias("models"), status.alias("status"))


def completeness(frames: DataFrame, horizon: int) -> DataFrame:
    """Per model: published hours within the horizon and whether all are there."""
    return frames.where((F.col("hour") >= 0) & (F.col("hour") < horizon)).groupBy("model").agg(
        F.count_distinct("hour").alias("hours"), F.max("hour").alias("last_hour"), (F.count_distinct("hour") == horizon).alias("complete")
    )


def fetch_order(frames: DataFrame, selected: int) -> DataFrame:
    """Frames ranked for loading: the selected hour, then later, then earlier ones by distance."""
    tier = F.when(F.col("hour") == selected, 0).when(F.col("hour") > selected, 1).otherwise(2)
    order = Window.partitionBy("model").orderBy("tier", F.abs(F.col("hour") - selected), "hour")
    return frames.withColumn("tier", tier).withColumn("place", F.row_number().over(order))


def hour_status(planned: DataFrame, expected: DataFrame, last: DataFrame) -> DataFrame:
    """model, hour, status: what a frame list shows for each hour.

    planned: model, hour of the run's plan; expected: model, hour, status of frames
    already seen; last: model, last_hour of the newest manifest. An hour of the
    manifest's span without a status of its own is ``ready`` up to its last hour
    and ``pending`` after it.
    """
    rows = planned.select("model", "hour").distinct().join(expected.select("model", "hour", "status"), ["model", "hour"], "left").join(last, "model", "left")
    return rows.select("model", "hour", F.coalesce("status", F.when(F.col("hour") <= F.col("last_hour"), "ready").otherwise("pending")).alias("status"))
