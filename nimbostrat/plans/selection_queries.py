"""Queries on the choice of records: averaged phases and the closure of wanted products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbostrat.operators import selection
from nimbostrat.plans.catalog import HEIGHT, PROFILES, requirements
from nimbostrat.plans.frame_queries import FILES_SQL, UNIVERSE, catalogue_records
from nimbostrat.plans.registry import query
from nimbostrat.sources import inventory

PHASES = list(inventory.PHASE_MASKS)
# Averages of the four phases: over the precipitation's window in some files, over another one or incomplete in others.
AVERAGED_SQL = FILES_SQL + f""", ave AS (SELECT hour, {len(UNIVERSE)} + i AS ordinal, param, 'surface' AS level, param || ':surface' AS name, hour % 3 + CASE WHEN hour % 7 = 1 THEN 1 ELSE 0 END AS a, hour AS b
        FROM files, (SELECT unnest({PHASES!r}) AS param, unnest(generate_series(1, {len(PHASES)})) AS i) WHERE hour % 7 < 4 AND (hour % 7 <> 2 OR i <> 3)),
    both_ AS (SELECT hour, ordinal, param, level, name, a, b, false AS averaged FROM win UNION ALL SELECT hour, ordinal, param, level, name, a, b, true FROM ave),
    rain AS (SELECT hour, ordinal, a, b FROM both_ WHERE param = 'APCP' AND b > a),
    exact AS (SELECT hour, a, b FROM both_ WHERE averaged AND b > a GROUP BY 1, 2, 3 HAVING count(DISTINCT param) = 4),
    now AS (SELECT hour FROM both_ WHERE param IN ('CSNOW', 'CRAIN', 'CFRZR', 'CICEP') AND level = 'surface' GROUP BY 1 HAVING count(DISTINCT param) = 4),
    known AS (SELECT DISTINCT r.hour, r.a, r.b, x.hour IS NOT NULL AS exact FROM rain r LEFT JOIN exact x ON x.hour = r.hour AND x.a = r.a AND x.b = r.b LEFT JOIN now n ON n.hour = r.hour WHERE x.hour IS NOT NULL OR n.hour IS NOT NULL)"""


def averaged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``catalogue_records`` with averages of the phases, and offsets that neighbours share."""
    rows = catalogue_records(spark, sf_dir)
    files = rows.select("hour").distinct()
    kinds = F.posexplode(F.array(*[F.lit(p) for p in PHASES])).alias("i", "param")
    ave = files.select("hour", kinds).where((F.col("hour") % 7 < 4) & ((F.col("hour") % 7 != 2) | (F.col("i") != 2)))
    window = F.concat_ws("", F.col("hour") % 3 + F.when(F.col("hour") % 7 == 1, 1).otherwise(0), F.lit("-"), "hour", F.lit(" hour ave fcst"))
    ordinal = F.col("i") + len(UNIVERSE) + 1
    ave = ave.select("hour", ordinal.alias("ordinal"), ordinal.cast("string").alias("record"), "param", F.lit("surface").alias("level"), window.alias("forecast"))
    return rows.unionByName(ave).withColumn("offset", F.floor(F.col("ordinal") / 2) * 200)


@query("averaged_mask_windows", f"WITH {AVERAGED_SQL} SELECT hour, a AS start_hour, b AS end_hour, exact FROM known")
def averaged_mask_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precipitation windows with known phases, and whether from averages over the same window."""
    return inventory.masked_candidates(inventory.with_windows(averaged_records(spark, sf_dir)))


def _tokens() -> str:
    rows = []
    for r in requirements():
        names = {*r["need"], *[x for g in r["groups"] for x in g], *([r["direct"]] if r["direct"] else []), *([":".join(HEIGHT)] if r["entry"] in PROFILES else [])}
        if not r["models"] or "hrrr" in r["models"]:
            rows += [f"('{r['entry']}', {repr(r['liquid']) if r['liquid'] else 'NULL'}, '{n}')" for n in sorted(names)]
    return "sel(entry, liquid, token) AS (VALUES " + ", ".join(rows) + ")"


SELECTED_SQL = f"""WITH {AVERAGED_SQL}, {_tokens()},
    tok AS (SELECT hour, CASE WHEN level ILIKE '%entire atmosphere%' THEN param || ':~' ELSE name END AS token, min(ordinal) AS ordinal FROM both_ GROUP BY 1, 2),
    own AS (SELECT hour, CASE param WHEN 'WEASD' THEN 'snow' ELSE 'ice' END AS liquid, ordinal FROM both_ WHERE param IN ('WEASD', 'FRZR') AND b > a AND b = hour QUALIFY row_number() OVER (PARTITION BY hour, param ORDER BY a - b, ordinal) = 1),
    src AS (SELECT f.hour, coalesce(bool_or(param = 'WEASD' AND b > a), false) OR f.hour IN (SELECT hour FROM known) AS snow, coalesce(bool_or(param = 'FRZR' AND b > a AND b = f.hour), false) OR f.hour IN (SELECT hour FROM known) AS ice FROM files f JOIN both_ USING (hour) GROUP BY f.hour),
    pick AS (SELECT r.hour, r.ordinal, k.a, k.b, k.exact FROM rain r JOIN known k ON k.hour = r.hour AND k.a = r.a AND k.b = r.b WHERE r.b = r.hour QUALIFY row_number() OVER (PARTITION BY r.hour ORDER BY r.a - r.b, r.ordinal) = 1),
    msk AS (SELECT p.hour, min(m.ordinal) AS ordinal FROM pick p JOIN both_ m ON m.hour = p.hour AND m.param IN ('CSNOW', 'CRAIN', 'CFRZR', 'CICEP') AND m.level = 'surface' AND (NOT p.exact OR (m.averaged AND m.a = p.a AND m.b = p.b)) GROUP BY p.hour, m.param),
    liq AS (SELECT hour, ordinal FROM own UNION SELECT x.hour, x.ordinal FROM (SELECT hour, ordinal FROM pick UNION ALL SELECT hour, ordinal FROM msk) x WHERE (SELECT count(*) FROM own o WHERE o.hour = x.hour) < 2),
    want AS (SELECT t.hour, t.ordinal, s.entry AS by_ FROM tok t JOIN sel s USING (token) JOIN src USING (hour) WHERE s.liquid IS NULL OR t.hour > 0 AND CASE WHEN s.liquid = 'snow' THEN snow ELSE ice END UNION SELECT hour, ordinal, 'liquid' FROM liq WHERE hour > 0),
    grp AS (SELECT hour, ordinal, list_sort(list(DISTINCT by_)) AS by_ FROM want GROUP BY 1, 2),
    rng AS (SELECT hour, ordinal, ordinal // 2 * 200 AS off, min(ordinal // 2 * 200) OVER (PARTITION BY hour ORDER BY ordinal // 2 * 200 RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM both_)
    SELECT r.hour, r.ordinal, r.ordinal::VARCHAR AS record, off AS first_byte, nxt - 1 AS last_byte, array_to_string(by_, ',') AS wanted_by FROM rng r JOIN grp g ON g.hour = r.hour AND g.ordinal = r.ordinal"""


@query("selected_records", SELECTED_SQL)
def selected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records to fetch for all products of one model, from each supplier's file."""
    out = selection.selected_records(averaged_records(spark, sf_dir), spark, "hrrr")
    return out.select("hour", "ordinal", "record", "first_byte", "last_byte", F.array_join("wanted_by", ",").alias("wanted_by"))
