"""Deterministic fields from the project's star-schema tables.

Each proxy is a Spark table and the same table as SQL, so that every operator
can run on the given data and be compared with another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US = 1704067200000000  # 2024-01-01
HOUR_US = 3600000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, v: one cell for each element of each embedding."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "x")
    ).select("row", "col", F.col("x").cast("double").alias("v"))


GRID_SQL = """grid AS (
    SELECT CAST(vec_id AS INTEGER) AS row, CAST(i - 1 AS INTEGER) AS col, CAST(embedding[i] AS DOUBLE) AS v
    FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))"""


def holed_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with a regular pattern of missing values."""
    hole = (F.col("row") * 31 + F.col("col") * 17) % 23 == 0
    return grid(spark, sf_dir).withColumn("v", F.when(~hole, F.col("v")))


HOLED_SQL = GRID_SQL + """, holed AS (
    SELECT row, col, CASE WHEN (row * 31 + col * 17) % 23 <> 0 THEN v END AS v FROM grid)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, cell, hour, value: hourly maxima of events, one model for each event type."""
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / HOUR_US).cast("bigint")
    return (
        table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("cell"), hour.alias("hour"), "value")
        .groupBy("model", "cell", "hour").agg(F.max("value").alias("value"))
    )


SERIES_SQL = f"""series AS (
    SELECT event_type AS model, user_id AS cell, CAST((epoch_us(ts) - {EPOCH_US}) // {HOUR_US} AS BIGINT) AS hour, max(value) AS value
    FROM events GROUP BY 1, 2, 3)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, hour: the distinct hours of each event type."""
    return series(spark, sf_dir).select("model", "hour").distinct()


FRAMES_SQL = SERIES_SQL + ", frames AS (SELECT DISTINCT model, hour FROM series)"

# Record kinds for the pseudo-inventory, by line number modulo 7.
RECORD_KINDS = [
    ("APCP", "surface"), ("TMP", "2 m above ground"), ("WEASD", "surface"), ("CAPE", "180-0 mb above ground"),
    ("CAPE", "surface"), ("UGRD", "10 m above ground"), ("FRZR", "surface"),
]


def inventory_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hour, ordinal, line: index lines made of line items; an hour, and so a file, for each supplier."""
    rows = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").cast("int").alias("hour"), "l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"))
    )
    kind = F.col("l_linenumber") % 7
    param = F.element_at(F.array(*[F.lit(p) for p, _ in RECORD_KINDS]), kind + 1)
    level = F.element_at(F.array(*[F.lit(x) for _, x in RECORD_KINDS]), kind + 1)
    start = F.least(F.col("part") % 6, F.col("hour")).cast("int")
    window = F.when(kind.isin(0, 2, 6), F.concat_ws("", start, F.lit("-"), F.col("hour"), F.lit(" hour acc fcst"))).otherwise(F.concat_ws("", F.col("hour"), F.lit(" hour fcst")))
    offset = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100
    line = F.concat_ws(":", F.concat_ws(".", "l_orderkey", "l_linenumber"), offset, F.lit("d=2024010100"), param, level, window, F.lit(""))
    return rows.select("hour", offset.alias("ordinal"), line.alias("line"))


LINES_SQL = """raw AS (
    SELECT CAST(l_suppkey AS INTEGER) AS hour, l_orderkey, l_linenumber, max(l_partkey) AS part
    FROM lineitem GROUP BY 1, 2, 3),
kinds(kind, param, level) AS (VALUES """ + ", ".join(f"({k}, '{p}', '{x}')" for k, (p, x) in enumerate(RECORD_KINDS)) + """),
lines AS (
    SELECT hour, l_orderkey * 1000 + l_linenumber * 100 AS ordinal,
        concat_ws(':', l_orderkey || '.' || l_linenumber, l_orderkey * 1000 + l_linenumber * 100, 'd=2024010100', param, level,
            CASE WHEN kind IN (0, 2, 6) THEN least(part % 6, hour) || '-' || hour || ' hour acc fcst' ELSE hour || ' hour fcst' END, '') AS line
    FROM raw JOIN kinds ON l_linenumber % 7 = kind)"""

# Pressure levels of the pseudo-soundings, by line number from 1.
LEVELS = [1000.0, 925.0, 850.0, 700.0, 500.0, 300.0, 250.0]


def soundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, p, z, t, rh, u, v: an order's line items as the levels of a column."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cell"), "l_linenumber").agg(
        F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.max("l_tax").alias("x"), F.max("l_extendedprice").alias("e")
    )
    k = F.col("l_linenumber")
    p = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), k).cast("double")
    z = 44330.0 * (1.0 - F.pow(p / 1013.25, F.lit(0.1903)))
    return rows.select(
        "cell", p.alias("p"), z.alias("z"), (300.0 - 0.0065 * z + (F.col("q") - 25.0) * 0.2).alias("t"), (20.0 + 800.0 * F.col("d")).alias("rh"),
        (F.col("q") * 0.5 + k).cast("double").alias("u"), (F.col("x") * 200.0 - k).cast("double").alias("v"),
    )


SOUNDINGS_SQL = """lev(k, p) AS (VALUES """ + ", ".join(f"({k}, CAST({p} AS DOUBLE))" for k, p in enumerate(LEVELS, 1)) + """),
items AS (
    SELECT l_orderkey AS cell, l_linenumber AS k, max(l_quantity) AS q, max(l_discount) AS d, max(l_tax) AS x FROM lineitem GROUP BY 1, 2),
heights AS (SELECT k, p, CAST(44330.0 AS DOUBLE) * (1 - pow(p / 1013.25, 0.1903)) AS z FROM lev),
soundings AS (
    SELECT cell, p, z, CAST(300.0 AS DOUBLE) - 0.0065 * z + (q - 25) * 0.2 AS t, CAST(20.0 AS DOUBLE) + 800.0 * d AS rh,
        CAST(q * 0.5 + k AS DOUBLE) AS u, CAST(x * 200.0 - k AS DOUBLE) AS v
    FROM items JOIN heights USING (k))"""
