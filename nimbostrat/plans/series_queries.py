"""Accumulation and time-axis queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nimbostrat.functions import winter
from nimbostrat.operators import accumulate, runs, timeaxis
from nimbostrat.plans.registry import query
from nimbostrat.sources.proxies import FRAMES_SQL, SERIES_SQL, frames, series, table
from nimbostrat.sources.shared import shared_path
from nimbostrat.streaming import sums

MODELS = ["click", "view", "purchase"]


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir)
    return rows.withColumn("value", F.when((F.col("cell") * 7 + F.col("hour")) % 11 != 0, F.col("value")))


HOLED_SERIES_SQL = SERIES_SQL + """, holed AS (
    SELECT model, cell, hour, CASE WHEN (cell * 7 + hour) % 11 <> 0 THEN value END AS value FROM series)"""
UPTO = "OVER (PARTITION BY model, cell ORDER BY hour ROWS UNBOUNDED PRECEDING)"


@query("run_max_prefix", f"WITH {HOLED_SERIES_SQL} SELECT model, cell, hour, max(CASE WHEN value IS NOT NULL THEN greatest(0, value) END) {UPTO} AS run_max FROM holed")
def run_max_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accumulate.run_max(_holed(spark, sf_dir)).select("model", "cell", "hour", "run_max")


@query(
    "run_max_source_transform",
    f"WITH {SERIES_SQL} SELECT model, cell, hour, round(max(greatest(0, (value - 200) * 2.2369362920544)) {UPTO}, 6) AS run_max FROM series",
)
def run_max_source_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = series(spark, sf_dir).withColumn("value", F.col("value") - 200)
    return accumulate.run_max(shifted, factor=2.2369362920544).select("model", "cell", "hour", F.round("run_max", 6).alias("run_max"))


@query(
    "cumulative_poison",
    f"WITH {HOLED_SERIES_SQL} SELECT model, cell, hour, round(CASE WHEN count(value) {UPTO} = count(*) {UPTO} THEN sum(value) {UPTO} END, 4) AS total FROM holed",
)
def cumulative_poison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accumulate.cumulative(_holed(spark, sf_dir)).select("model", "cell", "hour", F.round("total", 4).alias("total"))


@query(
    "weighted_term_sum",
    """WITH t AS (SELECT l_orderkey AS source, CASE WHEN l_linenumber % 2 = 1 THEN 1.0 ELSE -0.5 END AS w, CASE WHEN l_partkey % 13 <> 0 THEN l_quantity END AS v FROM lineitem)
    SELECT source, round(CASE WHEN count(v) = count(*) THEN greatest(0, sum(w * v)) END, 4) AS total FROM t GROUP BY source""",
)
def weighted_term_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("source"), F.when(F.col("l_linenumber") % 2 == 1, 1.0).otherwise(-0.5).alias("weight"),
        F.when(F.col("l_partkey") % 13 != 0, F.col("l_quantity")).alias("value"),
    )
    return accumulate.weighted_sum(terms, ("source",)).select("source", F.round("total", 4).alias("total"))


@query(
    "merge_weighted_terms",
    """SELECT l_suppkey, l_partkey, CAST(sum(CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END) AS DOUBLE) AS weight
    FROM lineitem GROUP BY ALL HAVING sum(CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END) <> 0""",
)
def merge_weighted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.when(F.col("l_linenumber") % 2 == 1, 1.0).otherwise(-1.0).alias("weight"))
    return accumulate.merge_terms(terms, ("l_suppkey", "l_partkey"))


@query(
    "rolling_window_diff",
    f"""WITH {SERIES_SQL}, c AS (SELECT model, cell, hour, sum(value) {UPTO} AS total FROM series)
    SELECT a.model, a.cell, a.hour, round(CASE WHEN a.hour <= 24 THEN a.total WHEN b.total IS NOT NULL THEN greatest(0, a.total - b.total) END, 4) AS rolling
    FROM c a LEFT JOIN c b ON a.model = b.model AND a.cell = b.cell AND a.hour = b.hour + 24""",
)
def rolling_window_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = accumulate.cumulative(series(spark, sf_dir))
    return accumulate.rolling_difference(totals, 24).select("model", "cell", "hour", F.round("rolling", 4).alias("rolling"))


COUNTS_SQL = FRAMES_SQL.replace("frames AS", "unused AS") + """, masks AS (
    SELECT cell, hour, count(*) FILTER (model = 'click') AS snow, count(*) FILTER (model = 'view') AS rain,
        count(*) FILTER (model = 'purchase') AS freezing, count(*) FILTER (model NOT IN ('click', 'view', 'purchase')) AS sleet
    FROM series GROUP BY 1, 2)"""


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, hour and a count for each phase."""
    of = lambda *m: F.count_if(F.col("model").isin(*m))
    return series(spark, sf_dir).groupBy("cell", "hour").agg(
        of("click").alias("snow"), of("view").alias("rain"), of("purchase").alias("freezing"), F.count_if(~F.col("model").isin(*MODELS)).alias("sleet")
    )


@query(
    "phase_fraction_single",
    f"WITH {COUNTS_SQL} SELECT cell, hour, round(CASE WHEN snow + rain + freezing + sleet > 0 THEN least(1.0, snow / (snow + rain + freezing + sleet)) ELSE 0 END, 6) AS fraction FROM masks",
)
def phase_fraction_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = accumulate.phase_fraction([F.col(k).cast("double") for k in ("snow", "rain", "freezing", "sleet")], F.col("snow").cast("double"))
    return masks(spark, sf_dir).select("cell", "hour", F.round(share, 6).alias("fraction"))


@query(
    "phase_fraction_sampled",
    f"WITH {COUNTS_SQL} SELECT cell, round(avg(CASE WHEN hour % 5 <> 0 THEN least(1.0, rain / (snow + rain + freezing + sleet)) END), 5) AS fraction FROM masks GROUP BY cell",
)
def phase_fraction_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["snow", "rain", "freezing", "sleet"]
    samples = masks(spark, sf_dir).withColumns({k: F.when(F.col("hour") % 5 != 0, F.col(k).cast("double")) for k in names})
    return accumulate.sampled_phase_fraction(samples, ("cell",), names, "rain").select("cell", F.round("fraction", 5).alias("fraction"))


@query(
    "precip_type_priority",
    f"WITH {COUNTS_SQL} SELECT cell, hour, CASE WHEN freezing >= 0.5 THEN 'freezing' WHEN sleet >= 0.5 THEN 'sleet' WHEN snow >= 0.5 THEN 'snow' WHEN rain >= 0.5 THEN 'rain' END AS kind FROM masks",
)
def precip_type_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = winter.precip_type(*[F.col(k) for k in ("rain", "snow", "freezing", "sleet")])
    return masks(spark, sf_dir).select("cell", "hour", kind.alias("kind"))


@query(
    "valid_time_intersection",
    f"""WITH {FRAMES_SQL}, f AS (SELECT * FROM frames WHERE model IN ('click', 'view', 'purchase')),
    s AS (SELECT hour FROM f GROUP BY hour HAVING count(*) = (SELECT count(DISTINCT model) FROM f))
    SELECT hour FROM s UNION ALL SELECT hour FROM f WHERE model = 'click' AND NOT EXISTS (SELECT 1 FROM s)""",
)
def valid_time_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeaxis.axis_intersection(frames(spark, sf_dir), MODELS)


@query("valid_time_union", f"WITH {FRAMES_SQL} SELECT DISTINCT hour FROM frames WHERE model IN ('click', 'view', 'purchase')")
def valid_time_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeaxis.axis_union(frames(spark, sf_dir), MODELS)


@query("valid_time_primary", f"WITH {FRAMES_SQL} SELECT DISTINCT hour FROM frames WHERE model = 'view'")
def valid_time_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeaxis.axis_union(frames(spark, sf_dir), ["view"])


@query(
    "nearest_frame",
    f"""WITH {FRAMES_SQL}, t AS (SELECT event_id AS target_id, CAST((epoch_us(ts) - 1704067200000000) // 3600000000 AS BIGINT) * 2 AS hour FROM events),
    m AS (SELECT t.target_id, t.hour, x.model FROM t, (SELECT DISTINCT model FROM frames) x),
    b AS (SELECT m.*, f.hour AS before FROM m ASOF LEFT JOIN frames f ON m.model = f.model AND m.hour >= f.hour),
    a AS (SELECT b.*, f.hour AS after FROM b ASOF LEFT JOIN frames f ON b.model = f.model AND b.hour <= f.hour),
    r AS (SELECT *, CASE WHEN before IS NULL OR after - hour < hour - before THEN after ELSE before END AS frame_hour FROM a)
    SELECT target_id, model, hour AS target_hour, frame_hour, abs(frame_hour - hour) * 60 AS delta_minutes FROM r""",
)
def nearest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets at twice the events' hours, many far beyond the last frame."""
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3600000000).cast("bigint")
    targets = table(spark, sf_dir, "events").select(F.col("event_id").alias("target_id"), (hour * 2).alias("hour"))
    return timeaxis.nearest_frame(targets, frames(spark, sf_dir))


ANCHORS = [0, 1, 3, 6, 12, 24, 36, 48]


@query(
    "probe_hours_forward_asof",
    f"""WITH {FRAMES_SQL}, a(anchor) AS (VALUES {", ".join(f"({x})" for x in ANCHORS)})
    SELECT model, min(hour) AS hour FROM frames GROUP BY model UNION SELECT model, max(hour) FROM frames GROUP BY model
    UNION SELECT model, min(hour) FROM frames JOIN a ON hour >= anchor GROUP BY model, anchor""",
)
def probe_hours_forward_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeaxis.forward_probe(frames(spark, sf_dir), ANCHORS)


@query(
    "published_prefix",
    f"""WITH {FRAMES_SQL}, w AS (SELECT model, unnest(generate_series(0, 96)) AS hour FROM (SELECT DISTINCT model FROM frames)),
    s AS (SELECT w.model, w.hour, min(CASE WHEN f.hour IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.model ORDER BY w.hour ROWS UNBOUNDED PRECEDING) AS whole
        FROM w LEFT JOIN frames f ON w.model = f.model AND w.hour = f.hour)
    SELECT model, hour FROM s WHERE whole = 1""",
)
def published_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = frames(spark, sf_dir)
    wanted = held.select("model").distinct().select("model", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(96).cast("bigint"))).alias("hour"))
    return timeaxis.published_prefix(wanted, held)


@query(
    "timeline_next_wrap",
    f"WITH {FRAMES_SQL} SELECT model, hour, coalesce(lead(hour) OVER (PARTITION BY model ORDER BY hour), min(hour) OVER (PARTITION BY model)) AS next_hour FROM frames",
)
def timeline_next_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeaxis.next_with_wrap(frames(spark, sf_dir))


@query(
    "timeline_status_overlap",
    f"""WITH {FRAMES_SQL} SELECT hour, count(DISTINCT model) AS models, CASE WHEN count(DISTINCT model) = 3 THEN 'all' WHEN count(DISTINCT model) > 1 THEN 'some' ELSE 'one' END AS status
    FROM frames WHERE model IN ('click', 'view', 'purchase') GROUP BY hour""",
)
def timeline_status_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeaxis.overlap_status(frames(spark, sf_dir), MODELS)


@query(
    "run_completeness",
    f"WITH {FRAMES_SQL} SELECT model, count(DISTINCT hour) AS hours, max(hour) AS last_hour, count(DISTINCT hour) = 48 AS complete FROM frames WHERE hour >= 0 AND hour < 48 GROUP BY model",
)
def run_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeaxis.completeness(frames(spark, sf_dir), 48)


@query(
    "task_tier_order",
    f"""WITH {FRAMES_SQL}, t AS (SELECT model, hour, CASE WHEN hour = 100 THEN 0 WHEN hour > 100 THEN 1 ELSE 2 END AS tier FROM frames)
    SELECT model, hour, tier, CAST(row_number() OVER (PARTITION BY model ORDER BY tier, abs(hour - 100), hour) AS INTEGER) AS place FROM t""",
)
def task_tier_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeaxis.fetch_order(frames(spark, sf_dir), 100)


@query(
    "manifest_overlay",
    """WITH n AS (SELECT l_orderkey AS frame, max(l_shipdate) AS stamp, count(*) AS layers FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT coalesce(o.o_orderkey, n.frame) AS frame, CASE WHEN n.frame IS NULL THEN 'kept' WHEN o.o_orderkey IS NULL THEN 'added' ELSE 'replaced' END AS state, coalesce(n.layers, 0) AS layers
    FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') o FULL JOIN n ON o.o_orderkey = n.frame""",
)
def manifest_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New frames over an older manifest: a full join in which the new side wins."""
    new = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("new_frame")).agg(F.count(F.lit(1)).alias("layers"))
    old = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey")
    state = F.when(F.col("new_frame").isNull(), "kept").when(F.col("o_orderkey").isNull(), "added").otherwise("replaced")
    return old.join(new, F.col("o_orderkey") == F.col("new_frame"), "full").select(F.coalesce("o_orderkey", "new_frame").alias("frame"), state.alias("state"), F.coalesce("layers", F.lit(0)).alias("layers"))


@query(
    "cycle_candidates",
    """SELECT strftime(TIMESTAMP '2024-01-03 14:00:00' - to_hours(CAST(h AS INTEGER)), '%Y%m%d-%H00Z') AS run_id, CAST(row_number() OVER (ORDER BY h) AS INTEGER) AS place
    FROM (SELECT unnest(generate_series(0, 72)) AS h) WHERE extract(hour FROM TIMESTAMP '2024-01-03 14:00:00' - to_hours(CAST(h AS INTEGER))) IN (0, 6, 12, 18)""",
)
def cycle_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model cycles of the last 72 hours before a fixed time, newest first."""
    at = F.expr("timestamp_ntz'2024-01-03 14:00:00'") - F.make_dt_interval(hours=F.col("h"))
    rows = spark.range(0, 73).select(F.col("id").cast("int").alias("h")).withColumn("at", at).where(F.hour("at").isin(0, 6, 12, 18))
    return rows.select(F.date_format("at", "yyyyMMdd-HH'00Z'").alias("run_id"), F.row_number().over(Window.orderBy("h")).alias("place"))


@query(
    "run_max_previous_hour",
    f"WITH {FRAMES_SQL} SELECT model, hour, max(CASE WHEN hour > 0 THEN hour END) OVER (PARTITION BY model ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_hour FROM frames",
)
def run_max_previous_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accumulate.previous_source_hour(frames(spark, sf_dir))


STEPS_SQL = FRAMES_SQL + ", steps AS (SELECT model, hour, coalesce(lag(hour) OVER (PARTITION BY model ORDER BY hour), 0) AS start_hour FROM frames WHERE hour > 0)"


@query(
    "snowfall_delta_chain",
    f"""WITH {STEPS_SQL}, d AS (SELECT model, hour, CASE WHEN count(value) = count(*) THEN sum(value) END AS value FROM (SELECT model, hour, CASE WHEN cell % 50 <> 7 OR hour < 400 THEN value END AS value FROM series WHERE hour > 0) GROUP BY 1, 2)
    SELECT model, hour, round(CASE WHEN count(value) OVER w = count(*) OVER w THEN sum(value) OVER w END, 3) AS total FROM d JOIN steps USING (model, hour) WINDOW w AS (PARTITION BY model ORDER BY hour ROWS UNBOUNDED PRECEDING)""",
)
def snowfall_delta_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of the steps between published hours, added up; unknown from the first unresolved step on."""
    rows = series(spark, sf_dir).where("hour > 0").withColumn("value", F.when((F.col("cell") % 50 != 7) | (F.col("hour") < 400), F.col("value")))
    deltas = rows.groupBy("model", "hour").agg(F.when(F.count("value") == F.count(F.lit(1)), F.sum("value")).alias("value"))
    before = F.coalesce(F.lag("hour").over(Window.partitionBy("model").orderBy("hour")), F.lit(0))
    steps = frames(spark, sf_dir).where("hour > 0").withColumn("start_hour", before)
    return accumulate.delta_accumulation(deltas, steps, ("model",)).select("model", "hour", F.round("total", 3).alias("total"))


@query(
    "grid_visibility",
    f"WITH {HOLED_SERIES_SQL} SELECT model, hour, coalesce(bool_or(value IS NOT NULL), false) AS any_finite, coalesce(bool_or(value > 450), false) AS above FROM holed GROUP BY 1, 2",
)
def grid_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accumulate.visible(_holed(spark, sf_dir), 450.0, ("model", "hour"))


# Steps, last hours and cycles of the models.
MODEL_STEPS = [("gfs", 384, 3), ("nam", 84, 3), ("nam3km", 60, 1), ("hrrr", 48, 1)]


@query(
    "model_hours",
    "WITH m(model, last, step) AS (VALUES " + ", ".join(f"('{m}', {n}, {k})" for m, n, k in MODEL_STEPS) + ") SELECT model, unnest(generate_series(0, last, step)) AS hour FROM m",
)
def model_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.full_hours(spark.createDataFrame(MODEL_STEPS, runs.MODEL_SCHEMA))


@query(
    "parse_hour_lists",
    """WITH l AS (SELECT o_orderkey AS request, o_custkey || ', ' || (o_orderkey % 7) || '.5,x,-3, ,' || (o_custkey % 90) AS hours FROM orders),
    x AS (SELECT request, try_cast(trim(unnest(string_split(hours, ','))) AS DOUBLE) AS hour FROM l)
    SELECT DISTINCT request, CAST(floor(hour + 0.5) AS BIGINT) AS hour, floor(hour + 0.5) <= 84 AS valid FROM x WHERE hour >= 0 UNION SELECT request, 0, true FROM l""",
)
def parse_hour_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists with blanks, halves, signs and words; a blank counts as 0. valid: within the model's last hour."""
    text = F.concat_ws("", "o_custkey", F.lit(", "), F.col("o_orderkey") % 7, F.lit(".5,x,-3, ,"), F.col("o_custkey") % 90)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), text.alias("hours"))
    return runs.parse_hours(rows, "hours").select("request", "hour", (F.col("hour") <= 84).alias("valid"))


@query(
    "run_valid_times",
    """WITH r AS (SELECT o_orderkey AS run, strftime(o_orderdate, '%Y%m%d') AS day, o_custkey % 24 AS cycle, o_orderkey % 120 AS hour FROM orders)
    SELECT run, day || '-' || lpad(CAST(cycle AS VARCHAR), 2, '0') || '00Z' AS run_id, strftime(strptime(day, '%Y%m%d') + to_hours(CAST(cycle + hour AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') AS valid_time FROM r""",
)
def run_valid_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.date_format("o_orderdate", "yyyyMMdd").alias("day"), (F.col("o_custkey") % 24).alias("cycle"), (F.col("o_orderkey") % 120).alias("hour"))
    return rows.select("run", runs.run_id(F.col("day"), F.col("cycle")).alias("run_id"), runs.valid_time(F.col("day"), F.col("cycle"), F.col("hour")).alias("valid_time"))


@query(
    "model_keys_normalised",
    "SELECT c_custkey, CASE WHEN lower(trim(k)) IN ('gfs', 'nam', 'nam3km', 'hrrr') THEN lower(trim(k)) END AS model FROM (SELECT c_custkey, (['GFS ', ' nam', 'Nam3km', 'hrrr', 'ecmwf', ''])[CAST(c_custkey % 6 + 1 AS INTEGER)] AS k FROM customer)",
)
def model_keys_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("GFS ", " nam", "Nam3km", "hrrr", "ecmwf", "")])
    return table(spark, sf_dir, "customer").select("c_custkey", runs.model_key(F.element_at(names, (F.col("c_custkey") % 6 + 1).cast("int"))).alias("model"))


@query(
    "planned_hour_status",
    f"""WITH {FRAMES_SQL}, p AS (SELECT DISTINCT model, unnest(generate_series(0, 96)) AS hour FROM frames), l AS (SELECT model, max(hour) FILTER (hour <= 60) AS last_hour FROM frames GROUP BY model),
    e AS (SELECT model, hour, 'failed' AS status FROM frames WHERE hour % 7 = 0)
    SELECT p.model, p.hour, coalesce(status, CASE WHEN p.hour <= last_hour THEN 'ready' ELSE 'pending' END) AS status FROM p LEFT JOIN e USING (model, hour) LEFT JOIN l USING (model)""",
)
def planned_hour_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = frames(spark, sf_dir)
    planned = held.select("model").distinct().select("model", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(96).cast("bigint"))).alias("hour"))
    last = held.groupBy("model").agg(F.max(F.when(F.col("hour") <= 60, F.col("hour"))).alias("last_hour"))
    return timeaxis.hour_status(planned, held.where("hour % 7 = 0").select("model", "hour", F.lit("failed").alias("status")), last)


@query(
    "streamed_totals",
    """WITH i AS (SELECT l_suppkey AS cell, l_orderkey AS a, l_linenumber AS b, max(l_quantity) AS q, max(l_partkey) AS p FROM lineitem GROUP BY 1, 2, 3),
    h AS (SELECT cell, row_number() OVER (PARTITION BY cell ORDER BY a, b) AS hour, CASE WHEN p % 499 <> 0 THEN q END AS value FROM i)
    SELECT cell, hour, round(CASE WHEN count(value) OVER w = count(*) OVER w THEN sum(value) OVER w END, 4) AS total FROM h WINDOW w AS (PARTITION BY cell ORDER BY hour ROWS UNBOUNDED PRECEDING)""",
)
def streamed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums since the start, of a stream whose files hold the hours out of order; a supplier's items are its hours."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), "l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_partkey").alias("p"))
    hour = F.row_number().over(Window.partitionBy("cell").orderBy("l_orderkey", "l_linenumber"))
    hours = rows.select("cell", hour.cast("long").alias("hour"), F.when(F.col("p") % 499 != 0, F.col("q")).cast("double").alias("value"))
    place = shared_path(spark, "stream")
    hours.repartition(4, F.col("hour") % 7).write.parquet(f"{place}/in")
    stream = spark.readStream.schema(hours.schema).option("maxFilesPerTrigger", 2).parquet(f"{place}/in")
    sums.run_to_table(sums.cumulative_sums(stream), f"{place}/out", f"{place}/state")
    return spark.read.parquet(f"{place}/out").select("cell", "hour", F.round("total", 4).alias("total"))
