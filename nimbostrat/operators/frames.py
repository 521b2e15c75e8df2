"""Frame plans, queues and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def canonical_time(text: Column) -> Column:
    """ISO times of five spellings as ``YYYY-MM-DDTHH:MM:SSZ``; others stay as they are."""
    raw = F.replace(F.trim(text), F.lit(" "), F.lit("T"))
    day = r"^\d{4}-\d{2}-\d{2}T"
    return (
        F.when(raw.rlike(day + r"\d{2}:\d{2}:\d{2}Z$"), raw)
        .when(raw.rlike(day + r"\d{2}:\d{2}Z$"), F.regexp_replace(raw, "Z$", ":00Z"))
        .when(raw.rlike(day + r"\d{2}:\d{2}$"), F.concat(raw, F.lit(":00Z")))
        .when(raw.rlike(day + r"\d{2}$"), F.concat(raw, F.lit(":00:00Z")))
        .otherwise(raw)
    )


def frame_plan(times: DataFrame, reference_us: int, most: int, step: int) -> DataFrame:
    """Hours of valid times since the reference, rounded, within 0..most and on the step."""
    hour = F.floor((F.unix_micros(F.col("valid")) - reference_us) / 3.6e9 + 0.5).cast("bigint")
    return times.withColumn("hour", hour).where((F.col("hour") >= 0) & (F.col("hour") <= most) & (F.col("hour") % step == 0))


def artifact_key(model: Column, run: Column, view: Column, hour: Column, name: Column) -> Column:
    """prefix/model/run/view/HHH/name."""
    return F.concat_ws("/", F.lit("artifacts"), model, run, view, F.lpad(hour.cast("string"), 3, "0"), name)


def interleaved(frames: DataFrame) -> DataFrame:
    """A queue over all models in which each is spread evenly, latest hours first."""
    order = Window.partitionBy("model").orderBy(F.desc("hour"))
    share = (F.row_number().over(order) - 0.5) / F.count(F.lit(1)).over(Window.partitionBy("model"))
    return frames.withColumn("stride", share)


def render_tasks(frames: DataFrame) -> DataFrame:
    """The parts of each frame in the order in which they depend on each other."""
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("rank")) for n, k in enumerate(("runmax-prefix", "base", "snow-prefix", "snow"))])
    return frames.select("*", F.explode(parts).alias("t")).select(*frames.columns, "t.kind", "t.rank")


def warmup_tasks(frames: DataFrame, layers: DataFrame, anchor: int) -> DataFrame:
    """Tasks of every frame and layer (layer, kind), one for each cache key, by distance from an hour."""
    rank = F.when(F.col("kind") == "layer", 0).when(F.col("kind") == "vector", 1).otherwise(2)
    tasks = frames.crossJoin(F.broadcast(layers)).withColumns({"distance": F.abs(F.col("hour") - anchor), "kind_rank": rank})
    tasks = tasks.withColumn("cache_key", F.concat_ws("|", "model", "hour", "layer"))
    first = Window.partitionBy("cache_key").orderBy("kind_rank")
    return tasks.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


def merged_frames(old: DataFrame, template: DataFrame, keys: tuple[str, ...], states: tuple[str, ...]) -> DataFrame:
    """Template frames with sizes and states of old ones; unknown states are pending."""
    before = old.select(*keys, F.col("bytes").alias("o_bytes"), F.col("state").alias("o_state"))
    state = F.coalesce("o_state", "state")
    return template.join(before, list(keys), "left").select(
        *keys, F.coalesce(F.nullif(F.col("o_bytes"), F.lit(0)), F.nullif(F.col("bytes"), F.lit(0)), F.lit(0)).alias("bytes"), F.when(state.isin(*states), state).otherwise("pending").alias("state")
    )


def status_lattice(states: DataFrame) -> DataFrame:
    """Per hour: loaded if all are, else the gravest of error, loading and pending."""
    n, has = F.count(F.lit(1)), lambda s: F.count_if(F.col("state") == s)
    status = F.when(has("loaded") == n, "loaded").when(has("error") > 0, "error").when(has("loading") > 0, "loading").otherwise("pending")
    return states.groupBy("hour").agg(status.alias("status"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """Each model's latest run with its frame count."""
    return runs.groupBy("model").agg(F.max(F.struct("run_id", "n")).alias("x")).select("model", "x.run_id", F.col("x.n").alias("frame_count"))


def inside(latitude: Column, longitude: Column, bounds) -> Column:
    """Within the bounds, longitudes taken modulo 360."""
    wrapped = F.pmod(longitude + 180.0, F.lit(360.0)) - 180.0
    return latitude.between(bounds.south, bounds.north) & wrapped.between(bounds.west, bounds.east)


def asset_keys(frames: DataFrame, layers: DataFrame, gates: list[int]) -> DataFrame:
    """frames (base) with one row for each artifact: layer, variant, key.

    layers: layer, kind. An image has one key, a height contour an image and its
    lines, a vector layer lines alone, a reflectivity layer an image for each gate.
    """
    image = F.struct(F.lit("").alias("variant"), F.concat("base", F.lit("/"), "layer", F.lit(".png")).alias("key"))
    lines = lambda end: F.struct(F.lit("lines").alias("variant"), F.concat("base", F.lit("/"), "layer", F.lit(end)).alias("key"))
    gated = F.array(*[F.struct(F.lit(f"dbz{g}").alias("variant"), F.concat("base", F.lit("/"), "layer", F.lit(f"-g{g}.png")).alias("key")) for g in gates])
    refs = F.when(F.col("kind") == "vector", F.array(lines("-vectors.json"))).when(F.col("kind") == "contour", F.array(image, lines("-contours.json"))).when(F.col("kind") == "reflectivity", gated).otherwise(F.array(image))
    rows = frames.crossJoin(F.broadcast(layers)).withColumn("ref", F.explode(refs))
    return rows.select(*frames.columns, "layer", "ref.variant", "ref.key")


def collected_keys(refs: DataFrame, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """keys, key: the artifacts of each frame, once; an optional one only where it has bytes."""
    wanted = F.col("key").isNotNull() & (F.col("key") != "") & (~F.col("optional") | (F.coalesce("bytes", F.lit(0)) > 0))
    return refs.where(wanted).select(*keys, "key").distinct()


def applied(refs: DataFrame, rendered: DataFrame, keys: tuple[str, ...] = ("frame", "layer")) -> DataFrame:
    """refs (keys, bytes) with the sizes of what was rendered: the bytes given, else the body's length; others stay."""
    new = rendered.select(*keys, F.coalesce(F.nullif(F.col("bytes"), F.lit(0)), F.col("length")).alias("new_bytes"), F.lit(True).alias("there"))
    return refs.join(new, list(keys), "left").withColumn("bytes", F.when(F.col("there"), F.col("new_bytes")).otherwise(F.col("bytes"))).drop("new_bytes", "there")


def template(frames: DataFrame, model: Column, run: Column, view: Column) -> DataFrame:
    """Planned frames (hour) with their base key and the state of one not yet rendered."""
    base = F.concat_ws("/", F.lit("artifacts"), model, run, view, F.lpad(F.col("hour").cast("string"), 3, "0"))
    return frames.withColumns({"base": base, "state": F.lit("pending")})


def parameter_order(ordered: Column, known: Column, hidden: list[str], fallback: list[str]) -> Column:
    """The parameters to offer: the given order as far as it is known, then what else is known, each once.

    Without any known parameter the whole order is taken; fallback parameters are
    always known, hidden ones never shown.
    """
    names = F.filter(F.transform(ordered, lambda x: F.trim(x)), lambda x: (F.size(known) == 0) | F.array_contains(known, x) | x.isin(*fallback))
    return F.filter(F.array_distinct(F.concat(names, known)), lambda x: ~x.isin(*hidden) & (x != ""))


def tasks_by_hour(tasks: DataFrame, keys: tuple[str, ...] = ("model", "hour")) -> DataFrame:
    """keys, tasks: how many tasks of each hour count for its status; hours with none are left out."""
    return tasks.where("affects_status").groupBy(*keys).agg(F.count(F.lit(1)).alias("tasks"))
