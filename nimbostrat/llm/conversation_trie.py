"""The trie of conversation prefixes, with sums over subtrees by pointer jumping.

A prefix is known by a digest: the sum of hashes of its turns at their places,
in four lanes of 32 bits.  Sums of prefixes are running sums, so a conversation
of any length is cut in blocks that add up.  The nodes are the distinct digests,
and each knows its parent's digest.  In round k every node adds what it has gathered to
its ancestor 2^k above and then learns the ancestor of that ancestor; after a
logarithm of the depth in rounds every node has the sum of its subtree.  The root
has everything, and is summed directly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbostrat.llm.common import bound_batches, forget, join_spread, saved, spread_from

FORK, FEW, BLOCK = 20, 4, 1024
#: Ids of conversations that are joined to one string at once: 2^CHUNK at most.
CHUNK = 12
WORD = r"[^\x20\x09-\x0D]+"

_LANES = [f"p{k}" for k in range(4)]
_NONE = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at, digest, words: each turn with its place, from 0, in its conversation.

    Turns stand in the order of ``turn``, null first, ties by the digest of role and
    text. The table is dealt by ranges of that order, so that a long conversation
    spans several tasks; each adds what the earlier ones hold.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "row"]
    dealt = saved(slim.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    held = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # only the first conversation of a part can have begun earlier: no more rows than parts
    begun = held.withColumn("before", F.sum("n").over(earlier)).where("before > 0").select(F.col("conv_id").alias("c"), F.col("part").alias("k"), "before")
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "digest", "row"))
    out = dealt.withColumn("local", place).join(F.broadcast(begun), (F.col("conv_id") == F.col("c")) & (F.col("part") == F.col("k")), "left")
    return out.select("conv_id", (F.col("local") - 1 + F.coalesce("before", F.lit(0))).cast("long").alias("at"), "digest", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, length), and their turns (conv_id, i, digest, words, last).

    A conversation c is the first h turns of conversation c - c % 20 and then its own
    turns after its first h, where h is the crc32 of c's decimal digits modulo 4.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % FEW
    own = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FORK).alias("base"), head.cast("int").alias("h"))
    taken = F.least(F.col("h"), F.coalesce("m", F.lit(0)))
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = saved(own.join(sizes.select(F.col("conv_id").alias("b"), F.col("n").alias("m")), F.col("base") == F.col("b"), "left").withColumn("taken", taken).select("conv_id", "n", "base", "h", "taken", length.cast("long").alias("length")))
    start = turns.where(F.col("at") < FEW - 1).select(F.col("conv_id").alias("b"), F.col("at").alias("i"), "digest", "words")
    heads = convs.where("taken > 0").join(start, (F.col("base") == F.col("b")) & (F.col("i") < F.col("h"))).select("conv_id", "i", "digest", "words", (F.col("i") + 1 == F.col("length")).alias("last"))
    # a conversation may hold a large share of all turns: its row goes to them
    total = convs.agg(F.sum("n")).first()[0] or 0
    about = convs.select(F.col("conv_id").alias("c"), "n", "h", "taken", "length")
    tails = join_spread(turns, ["conv_id"], about, ["c"], "n", spread_from(total)).where("at >= h").withColumn("i", F.col("taken") + F.col("at") - F.col("h"))
    tails = tails.select("conv_id", F.col("i").cast("long").alias("i"), "digest", "words", (F.col("i") + 1 == F.col("length")).alias("last"))
    return convs, heads.unionByName(tails)


def _hashes() -> list[Column]:
    """Four lanes of 32 bits: two hashes of a turn at its place."""
    out = []
    for k in (1, 2):
        h = F.xxhash64(F.lit(k), F.col("i"), F.col("digest"))
        out += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    return out


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, the digest p0..p3 of the prefix that ends here, its parent's q0..q3, words, last."""
    rows = turns.withColumns(dict(zip(_LANES, _hashes(), strict=True))).withColumn("block", F.floor(F.col("i") / BLOCK))
    sums = rows.where(F.col("i") >= 0).groupBy("conv_id", "block").agg(*[F.sum(p).alias(p) for p in _LANES])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("conv_id", "block", *[F.sum(p).over(earlier).alias(f"c{k}") for k, p in enumerate(_LANES)]).where("block > 0")
    local = Window.partitionBy("conv_id", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(carry, ["conv_id", "block"], "left")
    out = out.withColumns({f"s{k}": F.sum(p).over(local) + F.coalesce(f"c{k}", F.lit(0)) for k, p in enumerate(_LANES)})
    return out.select("conv_id", (F.col("i") + 1).alias("depth"), *[F.col(f"s{k}").alias(p) for k, p in enumerate(_LANES)], *[(F.col(f"s{k}") - F.col(p)).alias(f"q{k}") for k, p in enumerate(_LANES)], "words", "last")


def ends_digests(ends: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ends_sha256: the hash of each key's conv_ids, ascending, joined by commas.

    Ids are joined in chunks by their upper bits. A key with one chunk is hashed at
    once; chunks of the others pass in order through one hash, never held together.
    """
    chunk = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = saved(ends.groupBy(*keys, F.shiftright("conv_id", CHUNK).alias("chunk")).agg(chunk.alias("ids")))
    counted = chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("ids").alias("ids"))
    one = counted.where("n = 1").select(*keys, F.sha2("ids", 256).alias("ends_sha256"))
    many = chunks.join(counted.where("n > 1").select(*keys), keys, "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        found: list[tuple] = []
        for batch in batches:
            *lanes, ids = (c.to_pylist() for c in batch.select([*keys, "ids"]).columns)
            for *key, text in zip(*lanes, ids, strict=True):
                if key != at:
                    if at is not None:
                        found.append((*at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
        if at is not None:
            found.append((*at, digest.hexdigest()))
        if found:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*found, strict=True))[:-1]), pa.array([f[-1] for f in found])], names=[*keys, "ends_sha256"])

    streamed = many.repartition(*keys).sortWithinPartitions(*keys, "chunk").mapInArrow(run, ", ".join([*(f"{k} bigint" for k in keys), "ends_sha256 string"]))
    return one.unionByName(streamed)


def subtree_sums(nodes: DataFrame, values: list[str], deepest: int, rows: int) -> DataFrame:
    """conv_id, depth and the sums of ``values`` over each node's subtree, below the root.

    nodes: saved, with conv_id, depth, parent (conv_id of the parent node, which the
    depth completes) and values. In round k, ``parent`` is the ancestor 2^k above.
    """
    state, reach = nodes.select("conv_id", "depth", F.when(F.col("depth") > 1, F.col("parent")).alias("up"), *values), 1
    while reach < deepest:
        given = state.where("up IS NOT NULL").groupBy(F.col("up").alias("c"), (F.col("depth") - reach).alias("d")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"_{v}") for v in values])
        same = (F.col("conv_id") == F.col("c")) & (F.col("depth") == F.col("d"))
        more = {v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}
        summed = saved(state.join(given, same, "left").withColumns(more).select("conv_id", "depth", "up", *values, F.coalesce("n", F.lit(0)).alias("n")))
        if reach > 1:
            forget(state)
        if 2 * reach < deepest:
            above = summed.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("up").alias("next"), F.col("n").alias("below"))
            jump = summed.where(F.col("depth") > 2 * reach).withColumn("at", F.col("depth") - reach)
            jump = join_spread(jump, ["up", "at"], above, ["c", "d"], "below", spread_from(rows)).select("conv_id", "depth", F.col("next").alias("up"), *values)
            near = summed.where(F.col("depth") <= 2 * reach).select("conv_id", "depth", F.lit(None).cast("long").alias("up"), *values)
            state = saved(jump.unionByName(near))
            forget(summed)
        else:
            state = summed
        reach *= 2
    return state.select("conv_id", "depth", *values)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id, turn, role, text; other columns are ignored. Remainders have the sign of conv_id. Rows of a null
    conv_id belong to no conversation. A null role or text is empty, a null turn comes
    first, and turns of equal number stand in the order of their digests. Repeated rows are turns of
    their own. Without conversations there is no node, not even the root.
    """
    bound_batches(conversations.sparkSession)
    lower = ["depth", *_LANES]
    turns = saved(ordered_turns(conversations))
    convs, rows = rebuilt(turns)
    paths = saved(prefixes(rows))
    found = paths.groupBy(*lower).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.min(f"q{k}").alias(f"q{k}") for k in range(4)], F.min("words").alias("words")
    )
    nodes = saved(found)
    edges = nodes.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(f"q{k}").alias(p) for k, p in enumerate(_LANES)]).agg(F.count(F.lit(1)).alias("n_children"))
    mine = saved(nodes.join(edges, lower, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    forget(nodes)
    total, deepest = mine.agg(F.count(F.lit(1)), F.max("depth")).first()
    about = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count(F.when(F.col("length") == 0, 1)).alias("turnless")).first()
    upper = mine.select(F.col("conv_id").alias("parent"), "n_children", F.col("depth").alias("_d"), *[F.col(p).alias(f"_{p}") for p in _LANES])
    child = mine.where("depth > 1").withColumn("_at", F.col("depth") - 1).drop("n_children")
    joined = join_spread(child, ["_at", *[f"q{k}" for k in range(4)]], upper.withColumnRenamed("n_children", "_n"), ["_d", *[f"_{p}" for p in _LANES]], "_n", spread_from(total)).select("conv_id", "depth", "parent")
    own = [F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")]
    top = mine.where("depth = 1").select("conv_id", "depth", F.lit(about["conv_id"]).cast("long").alias("parent"))
    linked = saved(joined.unionByName(top).join(mine.select("conv_id", "depth", *own), ["conv_id", "depth"]))
    sums = subtree_sums(linked, ["n_leaves", "saved_tokens"], deepest or 0, total)
    ends = ends_digests(paths.where("last").select(*lower, "conv_id"), lower)
    out = mine.select("conv_id", *lower, "n_convs", "n_children").join(ends, lower, "left").join(linked.select("conv_id", "depth", F.col("parent").alias("parent_conv_id")), ["conv_id", "depth"]).join(sums, ["conv_id", "depth"])
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE))).select(*columns)
    if not about["n_convs"]:
        return below
    return below.unionByName(_root(about, convs, linked).select(*columns))


def _root(about: tuple, convs: DataFrame, linked: DataFrame) -> DataFrame:
    """The root's row; turnless conversations end there."""
    digest = F.lit(_NONE)
    whole = linked.agg(F.count(F.when(F.col("depth") == 1, 1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    if about["turnless"]:
        ends = ends_digests(convs.where("length = 0").select(F.lit(0).cast("long").alias("key"), "conv_id"), ["key"])
        digest = F.lit(ends.first()["ends_sha256"])
    return whole.select(
        F.lit(about["conv_id"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(about["n_convs"]).cast("long").alias("n_convs"),
        "n_children", F.greatest(F.coalesce("n_leaves", F.lit(0)), F.lit(1)).alias("n_leaves"), "saved_tokens", digest.alias("ends_sha256"),
    )
