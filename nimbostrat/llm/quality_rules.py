"""Quality rules whose thresholds keep a stated risk.

A text's score is the largest ratio of a feature to its limit: symbols and
capitals, repeated lines and words.  A cutoff rejects what scores above it.  For
each stratum the cutoffs of ``LEVELS`` are tested from lax to strict on labelled
documents that no cutoff was fitted to: a cutoff is certified when an exact
binomial bound says that a true false-rejection rate above ``RISK`` would hardly
ever show so few false rejections.

Tests of a stratum form a fixed sequence, since rejections of a laxer cutoff are
among those of a stricter one; strata share the error ``DELTA`` evenly.  So with a
probability of 1 - DELTA no stratum loses more than ``RISK`` of its good documents
that pass the base rules.  Of the certified cutoffs the one that separates the labels best is
taken; a stratum without one rejects nothing beyond the base rules.

All work is in column functions; a text never leaves its row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbostrat.llm.common import fresh, saved, within_reach

# The contract's words and symbols.
SPACE, WORD, NO_SYMBOL = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+", r"[^#*$%&|<>]+"
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 5, 10, 20
#: Cutoffs of the score, from lax to strict; 1 stands for the limits below.
LEVELS = (8.0, 6.0, 5.0, 4.0, 3.0, 2.5, 2.0, 1.5, 1.25, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3)
RISK, DELTA = 0.02, 0.05

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _windows(words: str, n: str) -> Column:
    """A hash for each window of words; equal windows have equal hashes."""
    parts = ", ".join(f"{words}[i{f' + {k}' if k else ''}]" for k in range(WINDOW))
    return F.expr(f"CASE WHEN {n} >= {WINDOW} THEN transform(sequence(0, {n} - {WINDOW}), i -> xxhash64({parts})) END")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score.

    Columns with such names are replaced. A null text has no words. Windows are first
    compared by hash; only a text with equal hashes sorts its windows, then as they are.
    """
    body, words, n, lines, hashes, order, starts = (fresh(x) for x in ("body", "words", "n", "lines", "hashes", "order", "starts"))
    kept = [c for c in docs.columns if c not in (*_COUNTS, "score")]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(body))
    out = out.withColumns({
        words: F.regexp_extract_all(body, F.lit(WORD), F.lit(0)),
        lines: F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD)),
        "word_chars": F.length(F.regexp_replace(body, SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(body, NO_SYMBOL, "")).cast("long"),
        "__upper": F.length(F.regexp_replace(body, r"[^\p{Lu}]+", "")),
        "__letters": F.length(F.regexp_replace(body, r"[^\p{L}]+", "")),
    }).withColumns({n: F.size(words), "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"), "__lines": F.size(lines)})
    out = out.withColumn(hashes, _windows(words, n))
    exact = f"sort_array(transform(sequence(0, {n} - {WINDOW}), i -> struct(array_join(slice({words}, i + 1, {WINDOW}), ' ') AS x, i AS i)))"
    out = out.withColumn(order, F.expr(f"CASE WHEN size({hashes}) > size(array_distinct({hashes})) THEN {exact} END"))
    out = out.withColumn(starts, F.expr(f"sort_array(transform(filter({order}, (e, k) -> coalesce(get({order}, k - 1).x = e.x, false) OR coalesce(get({order}, k + 1).x = e.x, false)), e -> e.i))"))
    covered = F.expr(f"aggregate(transform({starts}, (s, k) -> least(coalesce(get({starts}, k + 1) - s, {WINDOW}), {WINDOW})), 0L, (a, x) -> a + x)")
    out = out.withColumns({"n_words": F.col(n).cast("long"), "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long")})
    return out.withColumn("score", _score()).select(*[F.col(f"`{c}`") for c in kept], *_COUNTS, "score")


def _score() -> Column:
    share = lambda part, limit, whole: F.when(F.col(whole) > 0, F.col(part) * limit / F.col(whole)).otherwise(0.0)
    # Limits: a tenth of symbols, a fifth of capitals, three tenths of repeated lines, a fifth of repeated words.
    return F.greatest(share("n_symbols", 10.0, "word_chars"), share("__upper", 5.0, "__letters"), share("n_dup_lines", 10.0 / 3.0, "__lines"), share("n_repeat_words", 5.0, "n_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def log_tail(n: Column, k: Column, risk: float) -> Column:
    """ln P(X <= k) of a binomial variable of ``n`` trials at rate ``risk``, summed term by term."""
    odds, none = math.log(risk / (1 - risk)), math.log(1 - risk)
    start = F.struct((n * none).alias("term"), (n * none).alias("total"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (s["total"] + F.log1p(F.exp(term - s["total"]))).alias("total"))

    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, step, lambda s: s["total"])


def certified_cutoffs(scored: DataFrame, stratum: str, good: str, levels: tuple[float, ...] = LEVELS, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, cutoff, n_good, n_bad, good_lost, bad_caught: one row for each stratum with a certified cutoff.

    scored: stratum, score and whether a labelled row is good; null labels don't count.
    The stratum may be null, then it is one of its own. Of cutoffs that separate alike the laxest is taken.
    """
    beyond = lambda level, is_good: F.count(F.when((F.col("score") > level) & (F.col(good) == is_good), 1))
    tests = [F.struct(F.lit(v).alias("cutoff"), beyond(v, True).alias("good_lost"), beyond(v, False).alias("bad_caught")) for v in levels]
    counts = saved(scored.where(F.col(good).isNotNull()).groupBy(stratum).agg(F.count(F.when(F.col(good), 1)).alias("n_good"), F.count(F.when(~F.col(good), 1)).alias("n_bad"), F.array(*tests).alias("tests")))
    strata = max(counts.where("n_good > 0").count(), 1)
    each = counts.where("n_good > 0").select(stratum, "n_good", "n_bad", F.inline("tests"))
    # beyond the mean the tail is over a half: no bound needed
    near = each.where(F.col("good_lost") <= F.col("n_good") * risk)
    sure = near.where(log_tail(F.col("n_good"), F.col("good_lost"), risk) <= math.log(delta / strata))
    gain = F.col("bad_caught") * F.col("n_good") - F.col("good_lost") * F.col("n_bad")
    best = F.max_by(F.struct("cutoff", "n_good", "n_bad", "good_lost", "bad_caught"), F.struct(gain, F.col("cutoff")))
    return sure.groupBy(stratum).agg(best.alias("b")).select(stratum, "b.*")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", levels: tuple[float, ...] = LEVELS, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept, score, cutoff.

    docs: doc_id, text and the stratum; labels: doc_id and quality, 1 for good. Other
    columns are ignored. Of several labels of a doc_id the smallest counts; null labels and
    null ids count for nothing. A null text has no words and fails the base rules. Repeated
    rows are judged, and counted, one by one. ``cutoff`` is null where a stratum, which may
    be null itself, has no certified cutoff: then only the base rules reject. Without labels or
    documents nothing is certified.
    """
    own, known, id_ = fresh("stratum"), fresh("stratum"), fresh("doc_id")
    given = docs.select("doc_id", "text", F.col(f"`{stratum}`").alias(own))
    scored = saved(features(given).drop("text").withColumn("base_failed", base_failed()))
    judged = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias(id_)).agg((F.min("quality") == 1).alias("good"))
    holdout = scored.where(~F.col("base_failed")).join(judged, F.col("doc_id") == F.col(id_)).select(own, "score", "good")
    cutoffs = within_reach(saved(certified_cutoffs(holdout, own, "good", levels, risk, delta).select(F.col(own).alias(known), "cutoff")))
    out = scored.join(cutoffs, F.col(own).eqNullSafe(F.col(known)), "left")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("score") > F.col("cutoff"), F.lit(False))
    return out.select("doc_id", *_COUNTS, "base_failed", kept.alias("kept"), "score", "cutoff")
