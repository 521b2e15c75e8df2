"""Exact deduplication with heavy hitters taken out before the shuffle.

Frequent digests are found with counter-based frequent-item sketches of the
Misra-Gries kind, accumulated in many tasks and then combined.  Exact counts
verify the candidates; the winners, at most ``tracked`` of them, are broadcast
and settle their rows where they are read.  All other digests have few copies
and take an ordinary shuffle.  Only DataFrame functions are used.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbostrat.llm.common import saved

#: Items that one sketch tracks: a digest with more than about 5/tracked of all
#: rows can't be missed. It bounds the broadcast: 100 bytes an item.
TRACKED = 4096
#: Groups of tasks whose sketches are combined before the last step.
FAN_IN = 64


def digest(text: str = "text"):
    """SHA-256 of the text after lower-casing A-Z; null counts as empty."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.sha2(lowered.cast("binary"), 256)


def heavy_digests(keyed: DataFrame, tracked: int = TRACKED, least: int = 16) -> DataFrame:
    """Digests of at least ``least`` rows among the sketch's candidates, with exact figures.

    keyed: columns ``doc_id`` and ``text_sha256``.
    Gives at most ``tracked`` rows of text_sha256, keep_id, group_size.
    """
    sketches = keyed.groupBy(F.pmod(F.spark_partition_id(), F.lit(FAN_IN)).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(text_sha256, {tracked})").alias("sketch")
    )
    # Grouped by a key, so that a partition without sketches gives no empty one.
    whole = sketches.groupBy((F.col("part") >= 0).alias("any")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    found = whole.select(
        F.explode(F.expr(f"approx_top_k_estimate(sketch, {tracked})")).alias("x")
    )
    candidates = found.where(F.col("x.count") >= least).select(F.col("x.item").alias("text_sha256"))
    return (
        keyed.join(F.broadcast(candidates), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") >= least)
    )


def exact_dedup(docs: DataFrame, text: str = "text", tracked: int = TRACKED) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    docs: a table with ``doc_id`` and a string column named by ``text``; other
    columns are ignored. Of equal texts the row with the largest doc_id stays;
    null counts as an empty text. Rows that repeat a doc_id with an equal text
    are equal copies: each counts in group_size and each is marked as kept if
    its doc_id is. A null doc_id is never kept before others: it stays only in a
    group where all are null, as a null keep_id with kept true. An empty table
    gives an empty result.
    """
    keyed = saved(docs.select("doc_id", digest(text).alias("text_sha256")))
    heavy = saved(heavy_digests(keyed, tracked))  # at most `tracked` rows
    settled = keyed.join(F.broadcast(heavy), "text_sha256")
    rest = keyed.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    whole = settled.select(columns).unionAll(rest.join(groups, "text_sha256").select(columns))
    return whole.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
