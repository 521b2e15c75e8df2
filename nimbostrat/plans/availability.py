"""Which catalogue entries a run can provide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbostrat.sources.inventory import first_match, matches


def availability(records: DataFrame, selectors: DataFrame, keys: tuple[str, ...] = ("hour",)) -> DataFrame:
    """keys, entry, available: all required inputs matched, and one of each any-of group.

    selectors: entry, selector, param, level, level_regex, required, any_group
    (null outside groups). Entries without any match are listed, too.
    """
    hits = _hits(records, selectors, keys)
    groups = selectors.groupBy("entry", "any_group").agg(F.collect_list(F.when(F.col("any_group").isNotNull() | F.col("required"), F.col("selector"))).alias("of"))
    entries = groups.groupBy("entry").agg(F.flatten(F.collect_list(F.when(F.col("any_group").isNull(), F.col("of")))).alias("need"), F.collect_list(F.when(F.col("any_group").isNotNull(), F.col("of"))).alias("groups"))
    rows = hits.crossJoin(F.broadcast(entries))
    ok = (F.size(F.array_except("need", "hits")) == 0) & F.forall("groups", lambda g: F.arrays_overlap(g, F.col("hits")))
    return rows.select(*keys, "entry", ok.alias("available"))


def _hits(records: DataFrame, selectors: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, hits: the selectors that any record of a file matches; one pass, sets bounded by the catalogue."""
    chosen = selectors.select("selector", F.col("param").alias("s_param"), F.col("level").alias("s_level"), "level_regex")
    fits = matches()
    return records.join(F.broadcast(chosen), fits, "left").groupBy(*keys).agg(F.collect_set("selector").alias("hits"))


def missing_required(records: DataFrame, selectors: DataFrame, keys: tuple[str, ...] = ("hour",)) -> DataFrame:
    """keys, selector: required selectors without a record."""
    required = selectors.where("required").agg(F.collect_set("selector").alias("required"))
    missing = _hits(records, selectors, keys).crossJoin(F.broadcast(required)).select(*keys, F.explode(F.array_except("required", "hits")).alias("selector"))
    return missing


def parameters_of_run(available: DataFrame, required: list[str]) -> DataFrame:
    """Entries that any probed hour provides, and the required ones."""
    return available.groupBy("entry").agg(F.bool_or("available").alias("any")).where(F.col("any") | F.col("entry").isin(required)).select("entry")


def available_selections(records: DataFrame, selectors: DataFrame, keys: tuple[str, ...] = ("hour",)) -> DataFrame:
    """The matched records of available entries alone."""
    entries = availability(records, selectors, keys).where("available").select(*keys, "entry")
    of_entry = first_match(records, selectors, keys).join(F.broadcast(selectors.select("selector", "entry")), "selector")
    return of_entry.join(entries, [*keys, "entry"], "left_semi")
