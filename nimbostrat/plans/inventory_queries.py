"""Inventory, availability and interval-plan queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nimbostrat.operators import accumulate, intervals
from nimbostrat.plans.availability import availability, missing_required
from nimbostrat.plans.registry import query
from nimbostrat.sources.inventory import byte_ranges, dotted, first_match, parse_lines, range_header, with_windows
from nimbostrat.sources.proxies import FRAMES_SQL, LINES_SQL, frames, inventory_lines, series

RECORDS_SQL = LINES_SQL + """, records AS (
    SELECT hour, ordinal, line, split_part(line, ':', 1) AS record, CAST(split_part(line, ':', 2) AS BIGINT) AS "offset",
        split_part(line, ':', 4) AS param, split_part(line, ':', 5) AS level, split_part(line, ':', 6) AS forecast FROM lines)"""

# A small catalogue; entry, selector, param, level, level_regex, required, any_group.
SELECTORS = [
    ("temperature", "tmp2m", "TMP", "2 m above ground", None, True, None),
    ("precip", "apcp", "APCP", "surface", None, True, None),
    ("cape", "cape_any", "CAPE", None, None, True, None),
    ("wind", "u10", "UGRD", "10 m above ground", None, True, None),
    ("wind", "v10", "VGRD", "10 m above ground", None, True, None),
    ("ice", "frzr", "FRZR", "surface", None, False, 1),
    ("ice", "weasd", "WEASD", None, "^surf", False, 1),
    ("hail", "hail", "HAIL", "surface", None, False, 1),
]
SCHEMA = "entry string, selector string, param string, level string, level_regex string, required boolean, any_group int"


def _literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, bool | int) else f"'{x}'"


SELECTORS_SQL = "selectors(entry, selector, param, level, level_regex, required, any_group) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, s)) + ")" for s in SELECTORS) + ")"
MATCH_SQL = RECORDS_SQL + ", " + SELECTORS_SQL + """, hits AS (
    SELECT hour, selector, ordinal, record, r.level, row_number() OVER (PARTITION BY hour, selector ORDER BY
        CASE WHEN r.param = 'CAPE' AND s.level IS NULL AND s.level_regex IS NULL AND NOT regexp_matches(r.level, '180-0 mb above ground|surface|255-0 mb above ground', 'i') THEN 1 ELSE 0 END, ordinal, record) AS k
    FROM records r JOIN selectors s ON r.param = s.param AND (s.level IS NULL OR r.level = s.level) AND (s.level_regex IS NULL OR regexp_matches(r.level, s.level_regex))),
matched AS (SELECT hour, selector, ordinal, record, level FROM hits WHERE k = 1)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(inventory_lines(spark, sf_dir))


def selectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SELECTORS, SCHEMA)


@query(
    "idx_parse_windows",
    f"""WITH {RECORDS_SQL}, w AS (SELECT *, regexp_extract(forecast, '(\\d+)\\s*-\\s*(\\d+)\\s*hour\\s+acc', ['a', 'b']) AS x FROM records)
    SELECT hour, ordinal, param, level, try_cast(x.a AS BIGINT) AS start_hour, try_cast(x.b AS BIGINT) AS end_hour,
        greatest(0, try_cast(x.b AS BIGINT) - try_cast(x.a AS BIGINT)) + 0 * try_cast(x.a AS BIGINT) AS hours FROM w""",
)
def idx_parse_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_windows(records(spark, sf_dir)).select("hour", "ordinal", "param", "level", "start_hour", "end_hour", "hours")


@query(
    "idx_byte_ranges",
    f"""WITH {RECORDS_SQL}, r AS (SELECT hour, ordinal, "offset" AS first_byte,
        min("offset") OVER (PARTITION BY hour ORDER BY "offset" RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1 AS last_byte FROM records)
    SELECT hour, ordinal, first_byte, last_byte, 'bytes=' || first_byte || '-' || coalesce(CAST(last_byte AS VARCHAR), '') AS header FROM r""",
)
def idx_byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = byte_ranges(records(spark, sf_dir))
    return rows.select("hour", "ordinal", "first_byte", "last_byte", range_header(F.col("first_byte"), F.col("last_byte")).alias("header"))


@query("record_first_match", f"WITH {MATCH_SQL} SELECT hour, selector, ordinal, record, level FROM matched")
def record_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_match(records(spark, sf_dir), selectors(spark)).select("hour", "selector", "ordinal", "record", "level")


@query(
    "record_dotted_order",
    f"""WITH {RECORDS_SQL} SELECT hour, record, ordinal, CAST(row_number() OVER (PARTITION BY hour ORDER BY
        CAST(split_part(record, '.', 1) AS BIGINT), CAST(split_part(record, '.', 2) AS BIGINT)) AS INTEGER) AS place FROM records""",
)
def record_dotted_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("hour").orderBy(dotted(F.col("record")))
    return records(spark, sf_dir).select("hour", "record", "ordinal", F.row_number().over(order).alias("place"))


@query(
    "catalog_availability",
    f"""WITH {MATCH_SQL}, f AS (SELECT h.hour, s.entry, s.any_group, s.required, m.selector IS NOT NULL AS hit
        FROM (SELECT DISTINCT hour FROM records) h CROSS JOIN selectors s LEFT JOIN matched m ON m.hour = h.hour AND m.selector = s.selector),
    g AS (SELECT hour, entry, any_group, CASE WHEN any_group IS NULL THEN bool_and(NOT required OR hit) ELSE bool_or(hit) END AS ok FROM f GROUP BY 1, 2, 3)
    SELECT hour, entry, bool_and(ok) AS available FROM g GROUP BY 1, 2""",
)
def catalog_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return availability(records(spark, sf_dir), selectors(spark))


@query(
    "missing_required_anti",
    f"""WITH {MATCH_SQL} SELECT h.hour, s.selector FROM (SELECT DISTINCT hour FROM records) h CROSS JOIN selectors s
    WHERE s.required AND NOT EXISTS (SELECT 1 FROM matched m WHERE m.hour = h.hour AND m.selector = s.selector)""",
)
def missing_required_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_required(records(spark, sf_dir), selectors(spark))


SPANS_SQL = FRAMES_SQL + """, spans AS (
    SELECT model, hour AS start_hour, hour + k AS end_hour, CASE WHEN k = 1 THEN 0 ELSE 1 END AS kind_rank
    FROM frames, (VALUES (1), (3), (6)) t(k) WHERE hour % k = 0 AND hour >= 0)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of 1, 3 and 6 hours from published hours."""
    k = F.explode(F.array(F.lit(1), F.lit(3), F.lit(6)))
    rows = frames(spark, sf_dir).where("hour >= 0").select("model", "hour", k.alias("k")).where("hour % k = 0")
    return rows.select("model", F.col("hour").alias("start_hour"), (F.col("hour") + F.col("k")).alias("end_hour"), F.when(F.col("k") == 1, 0).otherwise(1).alias("kind_rank"))


@query(
    "interval_tiling_longest",
    f"""WITH RECURSIVE {SPANS_SQL}, t AS (SELECT model, start_hour, max(end_hour) AS end_hour FROM spans WHERE end_hour <= 24 GROUP BY 1, 2),
    walk AS (SELECT model, 1 AS step, start_hour, end_hour FROM t WHERE start_hour = 0
        UNION ALL SELECT w.model, w.step + 1, t.start_hour, t.end_hour FROM walk w JOIN t ON t.model = w.model AND t.start_hour = w.end_hour)
    SELECT * FROM walk WHERE model IN (SELECT model FROM walk GROUP BY model HAVING max(end_hour) = 24)""",
)
def interval_tiling_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.longest_tiling(spans(spark, sf_dir), 0, 24)


@query(
    "interval_path_priority",
    f"""WITH RECURSIVE {SPANS_SQL}, t AS (SELECT * FROM spans WHERE end_hour <= 24),
    back AS (SELECT DISTINCT model, CAST(24 AS BIGINT) AS hour FROM t UNION SELECT t.model, t.start_hour FROM back b JOIN t ON t.model = b.model AND t.end_hour = b.hour),
    best AS (SELECT *, row_number() OVER (PARTITION BY model, start_hour ORDER BY kind_rank, end_hour - start_hour, end_hour) AS k
        FROM t WHERE EXISTS (SELECT 1 FROM back b WHERE b.model = t.model AND b.hour = t.end_hour)),
    walk AS (SELECT model, 1 AS step, kind_rank, start_hour, end_hour FROM best WHERE k = 1 AND start_hour = 0
        UNION ALL SELECT w.model, w.step + 1, b.kind_rank, b.start_hour, b.end_hour FROM walk w JOIN best b ON b.k = 1 AND b.model = w.model AND b.start_hour = w.end_hour WHERE w.end_hour < 24)
    SELECT * FROM walk""",
)
def interval_path_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.ranked_path(spans(spark, sf_dir), 0, 24)


def _plans_sql(hours: int, totals: bool) -> str:
    """Terms of the last hours, written as recursion: chains of the earliest intervals, and greedy tiles where a chain breaks."""
    more = " UNION SELECT model, 0, hour FROM frames WHERE hour > 0" if totals else ""
    return f"""{SPANS_SQL}, h AS (SELECT * FROM frames WHERE hour >= 0), iv AS (SELECT DISTINCT model, start_hour AS a, end_hour AS b FROM (SELECT model, start_hour, end_hour FROM spans{more}) WHERE (model, end_hour) IN (SELECT model, hour FROM h)),
    first AS (SELECT model, b, min(a) AS a FROM iv GROUP BY 1, 2),
    chain AS (SELECT model, hour, hour AS pos, CAST(NULL AS BIGINT) AS upto FROM h WHERE hour > 0 UNION ALL SELECT c.model, c.hour, f.a, c.pos FROM chain c JOIN first f ON f.model = c.model AND f.b = c.pos WHERE c.pos > 0 AND (c.model, c.pos) IN (SELECT model, hour FROM h)),
    tile AS (SELECT model, hour, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM h WHERE hour > 0 UNION ALL SELECT t.model, t.hour, t.b, (SELECT max(i.b) FROM iv i WHERE i.model = t.model AND i.a = t.b AND i.b <= t.hour) FROM tile t WHERE t.b < t.hour),
    tiled AS (SELECT model, hour FROM tile GROUP BY 1, 2 HAVING max(b) = hour AND count(*) = count(b)),
    base AS (SELECT model, hour, CASE WHEN min(pos) = 0 THEN 0 ELSE min(CASE WHEN (model, pos) IN (SELECT model, hour FROM tiled) THEN pos END) END AS base FROM chain GROUP BY 1, 2),
    cum AS (SELECT c.model, c.hour, c.pos AS a, c.upto AS b FROM chain c JOIN base USING (model, hour) WHERE c.pos >= base AND c.upto IS NOT NULL AND base IS NOT NULL
        UNION ALL SELECT b.model, b.hour, t.a, t.b FROM base b JOIN tile t ON t.model = b.model AND t.hour = b.base WHERE t.b > 0),
    aim AS (SELECT model, hour, greatest(hour - {hours}, 0) AS start FROM h WHERE hour > 0),
    d AS (SELECT aim.model, aim.hour, a, b, CAST(1 AS DOUBLE) AS w FROM aim JOIN iv ON iv.model = aim.model AND iv.a = start AND iv.b = hour),
    rest AS (SELECT * FROM aim WHERE (model, hour) NOT IN (SELECT model, hour FROM d)),
    t AS (SELECT * FROM rest WHERE (model, hour) IN (SELECT model, hour FROM cum) AND (start = 0 OR (model, start) IN (SELECT model, hour FROM cum))),
    diff AS (SELECT model, hour, a, b, sum(w) AS w FROM (SELECT t.model, t.hour, a, b, 1.0 AS w FROM t JOIN cum ON cum.model = t.model AND cum.hour = t.hour UNION ALL SELECT t.model, t.hour, a, b, -1.0 FROM t JOIN cum ON cum.model = t.model AND cum.hour = t.start) GROUP BY 1, 2, 3, 4 HAVING abs(sum(w)) > 1e-9),
    s AS (SELECT * FROM rest WHERE (model, hour) NOT IN (SELECT model, hour FROM t)),
    walk AS (SELECT model, hour, start AS a, start AS b, 0 AS step FROM s UNION ALL SELECT w.model, w.hour, w.b, (SELECT max(i.b) FROM iv i WHERE i.model = w.model AND i.a = w.b AND i.b <= w.hour), step + 1 FROM walk w WHERE w.b < w.hour),
    fill AS (SELECT model, hour, a, b, 1.0 AS w FROM walk WHERE step > 0 AND (model, hour) IN (SELECT model, hour FROM walk GROUP BY 1, 2 HAVING max(b) = hour AND count(*) = count(b))),
    terms AS (SELECT model, hour, a AS start_hour, b AS end_hour, CAST(w AS DOUBLE) AS weight FROM (SELECT * FROM d UNION ALL SELECT * FROM diff UNION ALL SELECT * FROM fill))"""


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).where("hour >= 0")


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of 1, 3 and 6 hours, and totals since hour 0."""
    since = published(spark, sf_dir).where("hour > 0").select("model", F.lit(0).cast("bigint").alias("start_hour"), F.col("hour").alias("end_hour"))
    return spans(spark, sf_dir).select("model", "start_hour", "end_hour").unionByName(since)


@query("precip_window_terms", f"WITH RECURSIVE {_plans_sql(6, True)} SELECT * FROM terms")
def precip_window_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.window_terms(totals(spark, sf_dir), 6, published(spark, sf_dir))


@query("precip_cumulative_plan", f"WITH RECURSIVE {_plans_sql(24, False)} SELECT * FROM terms")
def precip_cumulative_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's terms where no totals are published, so that they are chained or tiled."""
    return intervals.window_terms(spans(spark, sf_dir).select("model", "start_hour", "end_hour"), 24, published(spark, sf_dir))


@query(
    "precip_window_fields",
    f"""WITH RECURSIVE {_plans_sql(6, True)}, f AS (SELECT model, cell, hour AS end_hour, value FROM series)
    SELECT x.model, x.cell, x.hour, round(CASE WHEN count(f.value) = count(*) THEN greatest(0, sum(weight * f.value * (terms.end_hour - terms.start_hour))) END, 4) AS total
    FROM series x JOIN terms ON terms.model = x.model AND terms.hour = x.hour LEFT JOIN f ON f.model = x.model AND f.cell = x.cell AND f.end_hour = terms.end_hour GROUP BY 1, 2, 3""",
)
def precip_window_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan joined to its fields; an interval's amount is its last hour's value times its length."""
    rows = series(spark, sf_dir)
    terms = intervals.window_terms(totals(spark, sf_dir), 6, published(spark, sf_dir))
    wanted = rows.select("model", "cell", "hour").join(F.broadcast(terms), ["model", "hour"])
    held = rows.select("model", "cell", F.col("hour").alias("end_hour"), "value")
    amounts = wanted.join(held, ["model", "cell", "end_hour"], "left").withColumn("value", F.col("value") * (F.col("end_hour") - F.col("start_hour")))
    return accumulate.weighted_sum(amounts, ("model", "cell", "hour")).select("model", "cell", "hour", F.round("total", 4).alias("total"))


LIQUID_SQL = SPANS_SQL + """, liq AS (SELECT DISTINCT model, kind, start_hour, end_hour FROM (
        SELECT model, 'direct' AS kind, start_hour, end_hour FROM spans WHERE end_hour % 5 <> 0 AND end_hour - start_hour <> 3
        UNION ALL SELECT model, 'direct', 0, hour FROM frames WHERE hour > 0 AND hour % 4 = 0 UNION ALL SELECT model, 'masked', start_hour, end_hour FROM spans WHERE end_hour - start_hour <= 3)),
    tot AS (SELECT model, end_hour AS hour FROM liq WHERE kind = 'direct' AND start_hour = 0 AND end_hour <= {end}),
    del AS (SELECT model, lag(hour) OVER (PARTITION BY model ORDER BY hour) AS a, hour AS b FROM (SELECT * FROM tot UNION SELECT DISTINCT model, 0 FROM tot)),
    ch AS (SELECT model, 'delta' AS kind, 0 AS kr, a, b FROM del WHERE a IS NOT NULL UNION SELECT model, kind, CASE kind WHEN 'direct' THEN 1 ELSE 2 END, start_hour, end_hour FROM liq WHERE end_hour <= {end}),
    back AS (SELECT DISTINCT model, CAST({end} AS BIGINT) AS hour FROM ch UNION SELECT c.model, c.a FROM back k JOIN ch c ON c.model = k.model AND c.b = k.hour),
    best AS (SELECT *, row_number() OVER (PARTITION BY model, a ORDER BY kr, b - a, b) AS k FROM ch WHERE (model, b) IN (SELECT model, hour FROM back)),
    path AS (SELECT model, 1 AS step, kind, a, b FROM best WHERE k = 1 AND a = 0 UNION ALL SELECT p.model, p.step + 1, e.kind, e.a, e.b FROM path p JOIN best e ON e.k = 1 AND e.model = p.model AND e.a = p.b WHERE p.b < {end})"""


def liquid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct intervals and totals with gaps, and masked precipitation."""
    rows, held = spans(spark, sf_dir), published(spark, sf_dir)
    long = F.col("end_hour") - F.col("start_hour")
    direct = rows.where((F.col("end_hour") % 5 != 0) & (long != 3)).select("model", F.lit("direct").alias("kind"), "start_hour", "end_hour")
    since = held.where("hour > 0 AND hour % 4 = 0").select("model", F.lit("direct").alias("kind"), F.lit(0).cast("bigint").alias("start_hour"), F.col("hour").alias("end_hour"))
    return direct.unionByName(since).unionByName(rows.where(long <= 3).select("model", F.lit("masked").alias("kind"), "start_hour", "end_hour"))


@query(
    "liquid_chunk_terms",
    f"""WITH RECURSIVE {LIQUID_SQL.format(end=30)} SELECT model, CAST(step AS INTEGER) AS step, kind, a AS start_hour, b AS end_hour, CASE WHEN kind = 'delta' AND a > 0 THEN 'direct:0-' || b || ':1,direct:0-' || a || ':-1'
        WHEN kind = 'delta' THEN 'direct:0-' || b || ':1' ELSE kind || ':' || a || '-' || b || ':1' END AS terms FROM path""",
)
def liquid_chunk_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snow or freezing-rain liquid of the first 30 hours: differences of totals, direct records, masked precipitation."""
    chunks = intervals.liquid_chunks(liquid(spark, sf_dir), 0, 30)
    text = F.transform("terms", lambda x: F.concat_ws("", x["kind"], F.lit(":"), x["start_hour"], F.lit("-"), x["end_hour"], F.lit(":"), x["weight"].cast("int")))
    return chunks.select("model", F.col("step").cast("int").alias("step"), "kind", "start_hour", "end_hour", F.array_join(text, ",").alias("terms"))


@query(
    "accumulation_resume_step",
    f"""WITH RECURSIVE {SPANS_SQL}, s AS (SELECT DISTINCT model, start_hour AS a, end_hour AS b FROM spans WHERE end_hour <= 96),
    r AS (SELECT DISTINCT model, CAST(0 AS BIGINT) AS hour FROM s UNION SELECT s.model, s.b FROM r JOIN s ON s.model = r.model AND s.a = r.hour)
    SELECT model, b AS hour, max(a) AS start_hour FROM s WHERE (model, a) IN (SELECT model, hour FROM r) GROUP BY 1, 2""",
)
def accumulation_resume_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.resume_steps(spans(spark, sf_dir), 96)


@query(
    "forecast_source_hours",
    f"""WITH {FRAMES_SQL}, t AS (SELECT model, max(hour) AS target FROM frames GROUP BY model), h AS (
        SELECT model, unnest(generate_series(0, least(target, 120))) AS hour FROM t WHERE target >= 0 UNION SELECT model, unnest(generate_series(123, target, 3)) FROM t WHERE target >= 123
        UNION SELECT model, hour FROM frames WHERE hour >= 0 UNION SELECT model, 0 FROM t)
    SELECT model, hour FROM h""",
)
def forecast_source_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly to 120 and every third hour after, with the published hours."""
    held = frames(spark, sf_dir)
    targets = held.groupBy("model").agg(F.max("hour").alias("target"))
    return intervals.source_hours(held, targets, 120, 3)
