"""Which records of a file to fetch for the products that are wanted.

From the wanted entries the closure goes through their own records, the members of
their groups, their profiles and the sources of their liquid; what comes out is one
ordered set of records a file, each with its bytes and what it is for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbostrat.plans import catalog
from nimbostrat.sources.inventory import PHASE_MASKS, average_bounds, byte_ranges, longest_ending, masked_candidates, with_windows

SELECTORS = "entry string, liquid string, token string"


def wanted_selectors(spark: SparkSession, model: str, wanted: list[str] | None = None) -> DataFrame:
    """entry, liquid, token: each record that an entry of a model asks for; a table of the catalogue's fixed size.

    A derived product with a profile also needs the height of the ground.
    """
    rows = []
    for r in catalog.requirements():
        if r["models"] and model not in r["models"] or wanted is not None and r["entry"] not in wanted:
            continue
        names = {*r["need"], *[x for g in r["groups"] for x in g], *([r["direct"]] if r["direct"] else [])}
        if r["entry"] in catalog.PROFILES:
            names.add(":".join(catalog.HEIGHT))
        rows += [(r["entry"], r["liquid"], n) for n in sorted(names)] or [(r["entry"], r["liquid"], None)]
    return spark.createDataFrame(rows, SELECTORS)


def liquid_records(records: DataFrame, keys: tuple[str, ...] = ("hour",), target: str = "hour") -> DataFrame:
    """keys, liquid, ordinal: the records that give a file's accumulated snow or ice.

    The longest accumulation of snow water, or of freezing rain, that ends at the target
    hour. Else the longest precipitation that ends there and whose phases are known,
    with the averages of the four phases over its window, or the first record of each
    phase where there are none. records: with windows.
    """
    own = [longest_ending(records, p, keys, target).select(*keys, F.lit(kind).alias("liquid"), "ordinal") for kind, p in (("snow", "WEASD"), ("ice", "FRZR"))]
    own = own[0].unionByName(own[1])
    known = masked_candidates(records, keys).withColumnsRenamed({"start_hour": "s", "end_hour": "e"})
    rain = longest_ending(records.join(known, [*keys]).where((F.col("start_hour") == F.col("s")) & (F.col("end_hour") == F.col("e"))), "APCP", keys, target)
    rain = rain.select(*keys, F.col("ordinal").alias("rain"), "s", "e", "exact")
    start, end = average_bounds(F.col("forecast"))
    phases = records.where(F.col("param").isin(*PHASE_MASKS) & (F.col("level") == "surface")).select(*keys, "param", "ordinal", start.alias("from"), end.alias("to"))
    fits = (F.col("from") == F.col("s")) & (F.col("to") == F.col("e"))
    masks = phases.join(rain, list(keys)).where(~F.col("exact") | fits).groupBy(*keys, "param").agg(F.min("ordinal").alias("ordinal"))
    masked = rain.select(*keys, F.col("rain").alias("ordinal")).unionByName(masks.select(*keys, "ordinal"))
    either = masked.select(*keys, "ordinal", F.explode(F.array(F.lit("snow"), F.lit("ice"))).alias("liquid"))
    return own.unionByName(either.join(own.select(*keys, "liquid"), [*keys, "liquid"], "left_anti"))


def selected_records(records: DataFrame, spark: SparkSession, model: str, wanted: list[str] | None = None, keys: tuple[str, ...] = ("hour",), target: str = "hour") -> DataFrame:
    """keys, ordinal, record, offset, first_byte, last_byte, wanted_by: the records to fetch from each file.

    wanted: entries, all of the model's if none are named. A selector takes its first record. An entry
    that accumulates asks for nothing at the run's start or without a source of its
    liquid. wanted_by has the entries, in order, and ``liquid`` for such a source.
    """
    selectors = wanted_selectors(spark, model, wanted)
    tokens = sorted({r["token"] for r in selectors.collect() if r["token"]})  # the catalogue's, not the data's
    patterns = sorted({t[:-2] for t in tokens if t.endswith(":~")})
    rows = with_windows(records)
    name = F.concat_ws(":", "param", "level")
    token = F.when(name.isin([t for t in tokens if not t.endswith(":~")]), name).when(F.col("param").isin(patterns) & F.col("level").rlike(catalog.WHOLE), F.concat("param", F.lit(":~")))
    first = rows.withColumn("token", token).where("token IS NOT NULL").groupBy(*keys, "token").agg(F.min("ordinal").alias("ordinal"))
    sources = catalog.liquid_sources(rows, keys, target)
    gate = (F.col(target) > 0) & F.when(F.col("liquid") == "snow", F.col("snow")).otherwise(F.col("ice"))
    plain = first.join(F.broadcast(selectors.where("token IS NOT NULL")), "token").join(sources, list(keys))
    plain = plain.where(F.col("liquid").isNull() | gate).select(*keys, "ordinal", F.col("entry").alias("by"))
    kinds = [r["liquid"] for r in selectors.where("liquid IS NOT NULL").select("liquid").distinct().collect()]
    liquid = liquid_records(rows, keys, target).where(F.col("liquid").isin(kinds) & (F.col(target) > 0)).select(*keys, "ordinal", F.lit("liquid").alias("by"))
    chosen = plain.unionByName(liquid).groupBy(*keys, "ordinal").agg(F.array_sort(F.collect_set("by")).alias("wanted_by"))
    return byte_ranges(records, keys).join(chosen, [*keys, "ordinal"]).select(*keys, "ordinal", "record", "offset", "first_byte", "last_byte", "wanted_by")
