"""Mixing sources to target weights by hierarchical budgeting.

Documents hang below domain, language and source.  A token budget flows from
the root down: siblings share their parent's budget by weight, up to what their
subtrees hold; what a child can't take goes to its siblings, and only a subtree
that is used up passes a shortage to its ancestors.  A leaf repeats its
documents in whole seeded epochs and takes the rest as a prefix, by tokens, of
one more epoch's order.  The plan has one row per leaf; documents are chosen by
comparing their order key with the leaf's cut, without a shuffle of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nimbostrat.llm.common import fresh, saved, within_reach

LEVELS = ("domain", "lang", "source")
#: Documents of a leaf in one bucket of its order, on average.
BUCKET_ROWS = 1000
NONE = "(none)"
# The project's tree and targets. A node not listed has weight 1.
DOMAIN_WEIGHTS = {"web": 0.6, "curated": 0.4}
LANG_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def domain_of(source: str = "source") -> Column:
    """``web`` for sources whose number is below 10, else ``curated``."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", "curated").when(number.cast("int") < 10, "web").otherwise("curated")


def word_count(text: str = "text") -> Column:
    """Runs without ASCII white space; a null text has none."""
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    table = weights.get(level) or {}
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col(level)] if table else F.lit(None).cast("double")
    return F.coalesce(known.cast("double"), F.lit(1.0))


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], budget: float, levels: tuple[str, ...] = LEVELS, epochs: float = 1.0) -> DataFrame:
    """``leaves`` (the levels and ``size``) with ``allocation``, in whole tokens.

    budget: tokens if above 1, else a share of all tokens. A leaf takes at most
    ``epochs`` times its size. Weights hold among siblings; a weight of 0 or
    less shuts a node out. Running sums go over siblings alone.
    """
    root = fresh("root")
    weighted = leaves.withColumn(root, F.lit(0)).withColumns({f"w_{k}": F.greatest(_weight(k, weights), F.lit(0.0)) for k in levels})
    live = F.lit(True)
    for k in levels:
        live = live & (F.col(f"w_{k}") > 0)
    nodes = [weighted.withColumn("cap", F.when(live, F.col("size") * F.lit(float(epochs))).otherwise(0.0))]
    for depth in range(len(levels) - 1, -1, -1):
        keys = [root, *levels[:depth], *[f"w_{k}" for k in levels[:depth]]]
        nodes.insert(0, nodes[0].groupBy(*keys).agg(F.sum("cap").alias("cap")))
    total = weighted.groupBy(root).agg(F.sum("size").cast("double").alias("all"))
    wanted = F.lit(float(budget)) if budget > 1 else F.col("all") * F.lit(float(budget))
    granted = nodes[0].join(total, root).select(root, F.least(wanted, "cap").alias("grant"))
    for depth, level in enumerate(levels, 1):
        above, keys = [root, *levels[: depth - 1]], [root, *levels[:depth]]
        rows = nodes[depth].join(granted.select(*above, F.col("grant").alias("b")), above)
        w, cap = F.col(f"w_{level}"), F.col("cap")
        rows = rows.withColumn("ratio", F.when(cap > 0, cap / w).otherwise(0.0)).withColumn("lw", F.when(cap > 0, w).otherwise(0.0))
        group = Window.partitionBy(*above)
        before = group.orderBy("ratio", level).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("full_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        rows = rows.withColumn("left_weight", F.sum("lw").over(group) - F.coalesce(F.sum("lw").over(before), F.lit(0.0)))
        rows = rows.withColumn("used_up", (cap <= 0) | (F.col("full_before") + F.col("ratio") * F.col("left_weight") <= F.col("b") * (1 + 1e-12)))
        taken = F.sum(F.when(F.col("used_up"), cap).otherwise(0.0)).over(group)
        open_weight = F.sum(F.when(~F.col("used_up"), F.col("lw")).otherwise(0.0)).over(group)
        share = F.when(F.col("used_up"), cap).otherwise((F.col("b") - taken) * F.col("lw") / open_weight)
        granted = rows.select(*keys, *([] if depth < len(levels) else ["size", "n_docs"]), share.alias("grant"))
    return granted.select(*levels, "size", "n_docs", F.floor(F.round("grant", 3)).cast("long").alias("allocation"))


def _order(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The order key of a document in one seeded epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(NONE))).cast("binary"))


def plan(docs: DataFrame, weights: dict[str, dict[str, float]], budget: float, tokens: Column, levels: tuple[str, ...] = LEVELS, epochs: float = 1.0, seed: int = 0) -> DataFrame:
    """Per leaf: the levels, size, n_docs, allocation, full (epochs), cut_key, cut_doc.

    A document is in the last, partial epoch if its order key and doc_id don't
    come after the cut. Buckets of the order spread a large leaf over tasks;
    only the one bucket that holds the cut is sorted.
    """
    named = [F.coalesce(F.col(k), F.lit(NONE)).alias(k) for k in levels]
    sized = saved(docs.select("doc_id", *named, tokens.alias("tokens")))
    leaves = sized.groupBy(*levels).agg(F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("n_docs"))
    granted = saved(budgets(leaves, weights, budget, levels, epochs).withColumn("full", F.when(F.col("size") > 0, F.floor(F.col("allocation") / F.col("size"))).otherwise(0).cast("long")))
    digits = F.least(F.lit(8), F.ceil(F.log(16.0, F.greatest(F.col("n_docs") / BUCKET_ROWS, F.lit(1.0))))).cast("int")
    granted = granted.withColumn("rest", F.col("allocation") - F.col("full") * F.col("size")).withColumn("digits", digits)
    placed = sized.join(within_reach(granted.select(*levels, "full", "rest", "digits")), list(levels))
    placed = placed.withColumn("key", _order(seed, F.col("full"), F.col("doc_id"))).withColumn("bucket", F.expr("substring(key, 1, digits)"))
    buckets = placed.groupBy(*levels, "bucket", "rest").agg(F.sum("tokens").alias("of_bucket"))
    running = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("of_bucket").over(running), F.lit(0)))
    cut = saved(buckets.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("of_bucket") > F.col("rest"))).select(*levels, "bucket", "before"))
    within = Window.partitionBy(*levels, "bucket").orderBy("key", "doc_id").rangeBetween(Window.unboundedPreceding, 0)
    last = (
        placed.join(within_reach(cut), [*levels, "bucket"]).withColumn("upto", F.col("before") + F.sum("tokens").over(within))
        .where(F.col("upto") <= F.col("rest")).groupBy(*levels).agg(F.max(F.struct("key", "doc_id")).alias("last"))
    )
    rows = granted.join(cut.select(*levels, "bucket"), list(levels), "left").join(last, list(levels), "left")
    # Without a document from its own bucket the cut is that bucket's name, which precedes all keys in it.
    return rows.select(*levels, "size", "n_docs", "allocation", "full", F.coalesce("last.key", "bucket", F.lit("")).alias("cut_key"), F.col("last.doc_id").alias("cut_doc"))


def apply_plan(docs: DataFrame, chosen: DataFrame, levels: tuple[str, ...] = LEVELS, seed: int = 0, level_columns: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` with ``n_copies``, the epochs in which each row is taken.

    chosen: a saved plan; up to a counted number of leaves it is broadcast, so
    that a leaf with a third of all rows stays spread as it was read.
    """
    names = {k: fresh(k) for k in levels}
    given = docs.withColumns({names[k]: F.coalesce((level_columns or {}).get(k, F.col(k)), F.lit(NONE)) for k in levels})
    table = chosen.select(*[F.col(k).alias(f"p_{names[k]}") for k in levels], F.col("full").alias(f"f_{names[levels[0]]}"), F.struct(F.col("cut_key").alias("k"), F.col("cut_doc").alias("d")).alias(f"c_{names[levels[0]]}"))
    on = F.lit(True)
    for k in levels:
        on = on & (F.col(names[k]) == F.col(f"p_{names[k]}"))
    full, cut = F.col(f"f_{names[levels[0]]}"), F.col(f"c_{names[levels[0]]}")
    key = _order(seed, full, F.col("doc_id"))
    # structs compare field by field, nulls first
    copies = full + F.when(F.struct(key.alias("k"), F.col("doc_id").alias("d")) <= cut, 1).otherwise(0)
    return given.join(within_reach(table), on).select(*[F.col(f"`{c}`") for c in docs.columns if c != "n_copies"], copies.cast("long").alias("n_copies"))


def mix(docs: DataFrame, weights: dict[str, dict[str, float]], budget: float, epochs: float = 1.0, seed: int = 0, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its domain (added or replaced) and ``n_copies``.

    docs: doc_id, lang, source and a text; further columns pass through. A null
    lang or source is a node of its own. A null or empty text has no tokens and
    is taken when its place in the order is before the cut. Rows that repeat a
    doc_id within a leaf are taken or left together. An empty table gives an
    empty result.
    """
    tree = docs.withColumn("domain", domain_of())
    return apply_plan(tree, saved(plan(tree, weights, budget, word_count(text), epochs=epochs, seed=seed)), seed=seed)
