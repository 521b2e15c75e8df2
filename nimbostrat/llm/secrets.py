"""Secret scans with multipart credential linking.

Patterns give spans of parts: assignments, access identifiers and hexadecimal
strings, which are always reported, and logins, endpoints and weak candidates
(long mixed strings), which are reported only where complementary parts share a
scope.  Scopes are windows of ``SCOPE`` code points around secret-like parts;
an interval join by buckets of that width pairs them with what lies inside.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nimbostrat.llm.common import fresh, saved

SCOPE = 160

# What each kind matches, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run holds a match of 20 characters if and only if its first AKIA has 16 after it.
ACCESS = r"AKIA[A-Z0-9]{16,}"
# The runs of [0-9a-f] of 24 characters or more.
HEX = r"[0-9a-f]{24,}"
LOGIN = r"""(?i)(user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+_.-]{3,})"""
ENDPOINT = r"""(?:https?|ftp|s3|postgres|postgresql|mysql|redis|mongodb|amqp)://[^\x20\x09-\x0D"'<>]+"""
CANDIDATE = r"[A-Za-z0-9+/_-]{32,}"
KINDS = ["assign", "access", "hex", "login", "endpoint", "candidate"]
BASE = ["assign", "access", "hex"]


def _parts(text, pattern: str, keep):
    """Per match, in order: the gap before it, its length, whether it counts."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.transform(matches, lambda m: F.struct(F.length(m).alias("size"), keep(m).alias("keep")))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.zip_with(F.slice(gaps, F.lit(1), F.size(lengths)), lengths, lambda g, m: F.struct(g.alias("gap"), m["size"].alias("size"), m["keep"].alias("keep")))
    return F.when(text.rlike(pattern), zipped)


def find_parts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, begin, end of all parts; ``end`` is exclusive, both in code points.

    Rows that repeat a key must repeat its text; they add nothing.
    """
    body = F.col(text)
    always = lambda m: F.lit(True)
    found = {
        # the value is what follows the separator, without an opening quote
        "assign": _parts(body, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        "access": _parts(body, ACCESS, always),
        "hex": _parts(body, HEX, always),
        "login": _parts(body, LOGIN, always),
        "endpoint": _parts(body, ENDPOINT, always),
        "candidate": _parts(body, CANDIDATE, lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")),
    }
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), found[k].alias("parts")) for k in KINDS])
    by_kind = docs.select(key, F.explode(kinds).alias("k")).where(F.col("k.parts").isNotNull())
    rows = by_kind.select(key, "k.kind", F.posexplode("k.parts").alias("pos", "p"))
    ordered = Window.partitionBy(key, "kind").orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy(key, "kind", "pos")
    # A repeated row repeats each part equally often, which the division undoes.
    end = (F.sum(F.col("p.gap") + F.col("p.size")).over(ordered) / F.count(F.lit(1)).over(same)).cast("long")
    placed = rows.withColumn("end", end).where(F.col("p.keep"))
    return placed.select(key, "kind", (F.col("end") - F.col("p.size")).alias("begin"), "end").distinct()


def link_parts(parts: DataFrame, key: str, scope: int = SCOPE) -> DataFrame:
    """Logins, endpoints and candidates that complementary parts report.

    A candidate needs an access identifier or a login within ``scope`` code
    points, itself apart. A login or an endpoint needs an assignment within that
    distance, or a candidate which is so reported. A candidate that overlaps a
    part of a base kind is that part and adds nothing.
    """
    cell = lambda x: F.floor(x / F.lit(scope))
    around = lambda df: df.withColumn("cell", F.explode(F.sequence(cell(F.col("begin") - scope), cell(F.col("end") + scope))))
    inside = lambda df: df.withColumn("cell", F.explode(F.sequence(cell(F.col("begin")), cell(F.col("end")))))

    def near(centres: DataFrame, others: DataFrame, within: int = scope) -> DataFrame:
        """Rows of centres with at least one of others within the distance."""
        other = inside(others).select(F.col(key).alias("o_key"), F.col("cell").alias("o_cell"), F.col("begin").alias("o_begin"), F.col("end").alias("o_end"))
        meet = (F.col(key) == F.col("o_key")) & (F.col("cell") == F.col("o_cell")) & (F.col("o_begin") < F.col("end") + within) & (F.col("o_end") > F.col("begin") - within)
        return around(centres).join(other, meet, "left_semi").drop("cell").distinct()

    of = lambda *kinds: parts.where(F.col("kind").isin(*kinds))
    covered = near(of("candidate"), of(*BASE), 0)
    free = of("candidate").join(covered, [key, "kind", "begin", "end"], "left_anti")
    candidates = near(free, of("access", "login"))
    linked = near(of("login", "endpoint"), of("assign").unionByName(candidates))
    return candidates.unionByName(linked)


def _joined(spans):
    """Spans as kind:start:end, ordered by start and then kind as listed."""
    ordered = F.sort_array(spans)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    docs: a table with ``doc_id`` and a string column named by ``text``; other
    columns are ignored. A null text counts as empty and has no span. Rows with
    the same doc_id and text get the same result each; rows that repeat a
    doc_id, null included, with another text are told apart.
    """
    key, body = fresh("key"), fresh("text")
    given = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias(body))
    given = given.withColumn(key, F.struct(F.coalesce("doc_id", F.lit(-1)).alias("a"), F.col("doc_id").isNull().alias("b"), F.xxhash64(body).alias("c")))
    parts = saved(find_parts(given, key, body))
    spans = parts.where(F.col("kind").isin(*BASE)).unionByName(link_parts(parts, key, scope))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct("begin", order.alias("order"), "kind", "end")
    base = F.col("kind").isin(*BASE)
    per_doc = spans.groupBy(key).agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE],
        F.collect_list(F.when(base, span)).alias("base"),
        F.collect_list(span).alias("all"),
    )
    zero = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE]
    text_of = lambda c: F.coalesce(_joined(F.col(c)), F.lit(""))
    return given.drop(body).join(per_doc, key, "left").select("doc_id", *zero, F.sha2(text_of("base").cast("binary"), 256).alias("base_sha256"), text_of("all").alias("spans"))
