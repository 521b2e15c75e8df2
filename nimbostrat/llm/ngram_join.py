"""N-gram Jaccard self-join over a count-vector R-tree.

Each text becomes the set of its distinct word shingles.  Shingles fall into
hash groups; the group counts are the text's point, and the summed minima of two
points' coordinates bound their sets' overlap from above.

Texts with equal sets form a class, joined through its representative alone.
Two sets that link share one of the shingles that come first in a global order
(a prefix of n - ceil(t n) + 1 each), so the points are sharded by such keys,
and in a shard points within the bound are connected.  A key of more points than
``RUN`` is dealt in parts; each part gives its groups' leaders with the distance
of their furthest member, and leaders whose groups may hold a link are connected
too.  The candidate clusters so found hold every link; in each, an R-tree over
the points finds what the bound allows, and those pairs are verified on the sets.
Very frequent shingles come last in the order, so shards stay small; they come
from a frequent-item sketch of fixed size over all texts.  The order affects only
the cost, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nimbostrat.llm.common import bound_batches, by_hash, forget, lean, mix64, saved, strings, within_reach

#: Groups of the points in the tree, and most and fewest groups of those sent by key.
GROUPS, MOST_GROUPS, FEWEST_GROUPS = 256, 1024, 64
#: Frequent shingles that the sketch tracks, 8 bytes each when broadcast.
TRACKED = 1 << 16
FREQUENT = 512
#: Sets verified together in one task; a larger cluster is dealt in blocks.
CLUSTER = 1024
#: Blocks that the sets of a large cluster meet in pairs, and times that these may be longer
#: than half of ``CLUSTER``: a text is sent to about so many tasks, not to more and more.
BLOCKS, LONGER = 16, 4
#: Shingles that the sets verified together hold, about 35 bytes each; it bounds
#: the memory of a task where the texts are long.
LOAD = 1 << 22
FANOUT = 16
#: Points of one key compared directly; more of them are dealt in parts of about so many.
RUN = 4096
#: Ids of exact copies that are broadcast at most, 8 bytes each.
COPIES = 2_000_000
#: Vertices of a task held before their edges are given out.
FOREST = 200_000
#: Characters of text shingled together.
CHUNK_CHARS = 1 << 20

#: Fixed: the integers of a packed point; the last kind has two counts in a byte.
_KINDS = ("u1", "<u2", "<u4")
_HALVES = len(_KINDS)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of non-empty words, encoded or not: a polynomial over their bytes."""
    coded = words if pa.types.is_dictionary(words.type) else words.dictionary_encode()
    values = coded.dictionary.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    powers = np.full(int(sizes.max(initial=0)) + 1, _A, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    local = np.arange(len(raw)) - np.repeat(starts, sizes)
    h = np.add.reduceat(raw * powers[local], starts) if len(values) else np.zeros(0, np.uint64)
    return mix64(h + sizes.astype(np.uint64) * _B)[coded.indices.to_numpy(zero_copy_only=False)]


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased.

    Words are runs without ASCII white space. A text with fewer words than
    ``width`` has its whole sequence as one shingle; without words, none.
    """
    start = 0
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    while start < len(texts):
        end, total = start + 1, sizes[start]
        while end < len(texts) and total + sizes[end] <= CHUNK_CHARS:
            total += sizes[end]
            end += 1
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(start, end - start)))
        owner, words = pc.list_parent_indices(split), pc.list_flatten(split)
        real = pc.greater(pc.binary_length(words), 0)
        h = word_hashes(words.filter(real))
        counts = np.bincount(owner.filter(real).to_numpy(zero_copy_only=False), minlength=end - start)
        powers = np.multiply.accumulate(np.full(width, _B, np.uint64))
        runs = np.zeros(max(len(h) - width + 1, 0), np.uint64)
        for k in range(width):
            runs += h[k : k + len(runs)] * powers[k]
        runs = mix64(runs)
        at = 0
        for n in counts.tolist():
            if n >= width:
                yield np.unique(runs[at : at + n - width + 1])
            elif n:
                yield mix64(np.array([np.sum(h[at : at + n] * powers[:n], dtype=np.uint64) ^ np.uint64(n)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            at += n
        start = end


def point(shingles: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Counts of the shingles by hash group; half the groups are sums of two."""
    return np.bincount((shingles >> np.uint64(3)).astype(np.int64) & (groups - 1), minlength=groups).astype(np.uint32)


def packed(counts: np.ndarray) -> bytes:
    """A byte that gives the groups and the kind of integer, and the counts in the narrowest one."""
    most = counts.max(initial=0)
    kind = _HALVES if most < 16 else int(np.searchsorted([1 << 8, 1 << 16], most, "right"))
    whole = counts.astype("u1" if kind == _HALVES else _KINDS[kind])
    return bytes([len(counts).bit_length() << 2 | kind]) + (whole[0::2] | whole[1::2] << 4 if kind == _HALVES else whole).tobytes()


class Points:
    """Packed points of several resolutions, compared at the coarser one of each pair."""

    def __init__(self, rows: pa.Array):
        raw = rows.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        heads = data[offsets[:-1]] if len(raw) else np.zeros(0, np.uint8)
        self.bits, self.row, self.counts = (heads >> 2).astype(np.int64), np.zeros(len(raw), np.int64), {}
        for bits in np.unique(self.bits).tolist():
            parts = []
            for kind in np.unique(heads[self.bits == bits] & 3).tolist():
                at = np.flatnonzero(heads == (bits << 2 | kind))
                width = (1 << bits - 1) * np.dtype(_KINDS[kind]).itemsize if kind < _HALVES else 1 << bits - 2
                body = np.ascontiguousarray(data[offsets[at][:, None] + np.arange(1, width + 1)])
                self.row[at] = np.arange(len(at)) + sum(map(len, parts))
                parts.append(body.view(_KINDS[kind]) if kind < _HALVES else np.stack([body & 15, body >> 4], axis=-1).reshape(len(at), -1))
            self.counts[bits] = np.concatenate(parts) if len(parts) > 1 else parts[0]

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Summed minima of the points numbered ``a`` and those numbered ``b``, pair by pair."""
        out, kinds = np.zeros(len(a), np.int64), self.bits[a] << 8 | self.bits[b]
        for kind in np.unique(kinds).tolist():
            some, (x, y) = np.flatnonzero(kinds == kind), (kind >> 8, kind & 255)
            left, right = self.counts[x][self.row[a[some]]], self.counts[y][self.row[b[some]]]
            low = 1 << min(x, y) - 1
            if x != y:
                left, right = (m.reshape(len(some), -1, low).sum(axis=1, dtype=np.int64) for m in (left, right))
            out[some] = np.minimum(left, right).sum(axis=1, dtype=np.int64)
        return out


class Threshold:
    """Links: 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        self.percent, self.t = percent, percent / 100
        self.radius = (1 - self.t) / (1 + self.t)

    def prefix(self, n: int) -> int:
        """Shingles of which a linked set shares at least one."""
        return n - -(-self.percent * n // 100) + 1 if n else 0

    def inner(self, n: int) -> int:
        """Shingles of which one is the first that a set shares with a linked one of its own size or more: both hold 2 t / (1 + t) of it."""
        return n - -(-2 * self.percent * n // (100 + self.percent)) + 1 if n else 0

    def groups(self, n: int) -> int:
        """Groups at which unrelated points of n shingles lie seven deviations beyond the bound.

        Their counts are about Poisson, so of n = g * m shingles in g groups about n * (1 - (pi * m) ** -0.5)
        are in the minima, with a deviation of ((0.5 - 1 / pi) * n) ** 0.5. Fewer deviations
        leave a share of all pairs, and as tables grow that share connects most texts.
        """
        wanted = math.pi * (self.radius * n**0.5 + 7 * (0.5 - 1 / math.pi) ** 0.5) ** 2
        return min(max(1 << int(wanted).bit_length(), FEWEST_GROUPS), MOST_GROUPS)

    def links(self, shared, n, m):
        return 100 * shared >= self.percent * (n + m - shared)

    def close(self, overlap, n, m):
        """Whether a bound on the intersection allows a link."""
        return (100 + self.percent) * overlap >= self.percent * (n + m)


def frequent_shingles(docs: DataFrame, text: str, width: int, tracked: int = TRACKED) -> np.ndarray:
    """Sorted hashes of the shingles that most texts hold, at most ``tracked``.

    Covers the lowest quarter of the hash range, where nearly all prefixes lie.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = np.uint64(1 << 62)
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(strings(batch.column(0)), width)]
            rows = [s[(s.view(np.uint64) ^ np.uint64(1 << 63)) < limit] for s in sets]
            for i in range(0, len(rows), 512):
                part = np.concatenate(rows[i : i + 512])
                yield pa.RecordBatch.from_arrays([pa.array(part)], names=["key"])

    keys = docs.select(F.col(text).alias("text")).mapInArrow(lean(run), "key bigint")
    sketches = keys.groupBy(F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")).agg(F.expr(f"approx_top_k_accumulate(key, {tracked})").alias("sketch"))
    whole = sketches.groupBy((F.col("part") >= 0).alias("any")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    rows = whole.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {tracked})")).alias("x")).where(F.col("x.count") >= FREQUENT)
    return np.sort(np.array([r["key"] for r in rows.select(F.col("x.item").alias("key")).collect()], np.int64))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def signatures(docs: DataFrame, text: str, width: int, limits: Threshold, frequent: np.ndarray) -> DataFrame:
    """rid, doc_id, text_hash, n, set_hash (16 bytes), point, prefix, common of every row.

    common holds those keys of the prefix that are known to be frequent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for batch in batches:
            n, hashes, points, prefixes, commons = [], [], [], [], []
            for s in shingle_sets(strings(batch.column(1)), width):
                signed = np.sort(s.view(np.int64))
                size = limits.prefix(len(s))
                if len(last) and len(s):
                    at = np.minimum(np.searchsorted(last, signed), len(last) - 1)
                    often = last[at] == signed
                    first = signed[~often][:size]
                    common = signed[often][: size - len(first)]
                else:
                    first, common = signed[:size], signed[:0]
                n.append(len(s))
                hashes.append(np.array([mix64(s ^ _A).sum(dtype=np.uint64), mix64(s ^ _B).sum(dtype=np.uint64)]).tobytes())
                points.append(packed(point(s, limits.groups(len(s)))))
                prefixes.append(first)
                commons.append(common)
            columns = [batch.column(0), batch.column(2), pa.array(n, pa.int32()), pa.array(hashes, pa.binary()), pa.array(points, pa.binary()), _lists(prefixes), _lists(commons)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n", "set_hash", "point", "prefix", "common"])

    given = docs.select("doc_id", F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    rows = given.mapInArrow(lean(run), "doc_id bigint, text_hash bigint, n int, set_hash binary, point binary, prefix array<bigint>, common array<bigint>")
    return rows.withColumn("rid", F.monotonically_increasing_id())


def shared_keys(entries: DataFrame, limits: Threshold) -> DataFrame:
    """The entries (key, n, rid) whose key another set of a fitting size has.

    entries: also whether the key is one of the set's first ``inner`` ones. Of two linked sets
    the first shingle that they share is one of these in the smaller one. Keys come in order of
    size, so a row is judged by the next one and the last such one before it; no task
    holds a key's rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fits, last = None, False, (0, -1)  # the last row, whether one before it fits, and key and size of the last inner row
        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            if not rows.num_rows:
                continue
            key, n, inner = (rows.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            n = n.astype(np.int64)
            at = np.maximum.accumulate(np.where(inner, np.arange(len(key)), -1))[:-1]
            small = np.where(at >= 0, n[at], np.where(key[1:] == last[0], last[1], -1))
            smaller = (np.where(at >= 0, key[at], last[0]) == key[1:]) & (small >= 0) & (100 * small >= limits.percent * n[1:])
            larger = inner[:-1] & (key[1:] == key[:-1]) & (100 * n[:-1] >= limits.percent * n[1:])
            before = np.concatenate([[fits], smaller])
            keep = before | np.concatenate([larger, [False]])
            yield rows.slice(0, len(key) - 1).filter(pa.array(keep[:-1])).select(["key", "n", "rid"])
            if len(some := np.flatnonzero(inner)):
                last = key[some[-1]], n[some[-1]]
            held, fits = rows.slice(len(key) - 1), bool(before[-1])
        if held is not None and fits:
            yield held.select(["key", "n", "rid"])

    ordered = entries.select("key", "n", "rid", "inner").repartition("key").sortWithinPartitions("key", "n", "rid")
    return ordered.mapInArrow(lean(run), "key bigint, n int, rid bigint")


class Forest:
    """Disjoint sets over the edges of one task, given out as stars."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, v: int) -> int:
        top = v
        while (up := self.above.setdefault(top, top)) != top:
            top = up
        while self.above[v] != top:
            self.above[v], v = top, self.above[v]
        return top

    def add(self, edges: Iterable[tuple[int, int]]) -> None:
        for a, b in edges:
            a, b = self.root(a), self.root(b)
            if a != b:
                self.above[max(a, b)] = min(a, b)

    def stars(self) -> pa.RecordBatch:
        found = np.array([(v, r) for v in self.above if (r := self.root(v)) != v], np.int64).reshape(-1, 2)
        self.above = {}
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def near_groups(sizes: np.ndarray, points: Points, start: int, limits: Threshold) -> np.ndarray:
    """For each of the points from ``start`` on, sizes ascending, the first one that it reaches over possible links."""
    root, open_ = np.arange(len(sizes)), np.ones(len(sizes), bool)
    low = np.searchsorted(sizes, sizes * limits.t * (1 - 1e-9))
    high = np.searchsorted(sizes, sizes / limits.t * (1 + 1e-9), "right")
    for first in range(len(sizes)):
        if not open_[first]:
            continue
        open_[first], queue = False, [first]
        while queue:
            k = queue.pop()
            some = low[k] + np.flatnonzero(open_[low[k] : high[k]])
            if len(some):
                overlap = points.overlap(np.full(len(some), start + k), start + some)
                some = some[limits.close(overlap, sizes[some], sizes[k])]
                open_[some], root[some] = False, first
                queue.extend(some.tolist())
    return root


_LEADER = {"key": pa.int64(), "rid": pa.int64(), "low": pa.int64(), "high": pa.int64(), "reach": pa.int64(), "point": pa.binary()}


def candidate_edges(entries: DataFrame, points: DataFrame, limits: Threshold) -> DataFrame:
    """a, b: stars that connect what may link; entries: key, rid, n (saved); points: rid, point.

    The points of one key come together, sizes ascending, and are compared with
    each other until all are connected. A key of more than ``RUN`` points comes
    in parts, and the leaders of the parts' groups are connected afterwards.
    """
    most = RUN
    hot = saved(entries.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most))
    parts = F.when(F.col("c").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("rid"), F.ceil(F.col("c") / most))).alias("part")
    dealt = entries.join(within_reach(hot), "key", "left").select("key", parts, "n", "rid").join(points, "rid").select("key", "part", "n", "rid", "point")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), None

        def settle(rows: pa.RecordBatch) -> pa.RecordBatch:
            """Edges of complete groups into the forest; the leaders of parts are returned."""
            keys, part, sizes, rids = (rows.column(c).to_numpy().astype(np.int64) for c in range(4))
            points = Points(rows.column(4))
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(keys) != 0) | (np.diff(part) != 0)) + 1, [len(keys)]])
            lengths = np.diff(cuts)
            two = cuts[:-1][(lengths == 2) & (part[cuts[:-1]] == 0)]
            two = two[limits.close(points.overlap(two, two + 1), sizes[two], sizes[two + 1])]
            forest.add(zip(rids[two].tolist(), rids[two + 1].tolist(), strict=True))
            leaders = []
            more = (lengths > 2) | (part[cuts[:-1]] > 0)
            for a, b in zip(cuts[:-1][more].tolist(), cuts[1:][more].tolist(), strict=True):
                own = rids[a:b].tolist()
                if not part[a] and len({forest.root(r) for r in own}) == 1:
                    continue
                root = near_groups(sizes[a:b], points, a, limits)
                forest.add((own[k], own[r]) for k, r in enumerate(root.tolist()) if r != k)
                if part[a]:
                    apart = sizes[a:b] + sizes[a + root] - 2 * points.overlap(np.arange(a, b), a + root)
                    for k in np.unique(root).tolist():
                        of = a + np.flatnonzero(root == k)
                        # at the coarsest resolution of its group, so that distances to members bound from above
                        centre = points.counts[points.bits[a + k]][points.row[a + k]].reshape(-1, 1 << points.bits[of].min() - 1).sum(axis=0, dtype=np.int64)
                        leaders.append((int(keys[a]), own[k], int(sizes[of].min()), int(sizes[of].max()), int(apart[of - a].max()), packed(centre)))
            columns = zip(*leaders, strict=True) if leaders else [[]] * len(_LEADER)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _LEADER.values(), strict=True)], names=list(_LEADER))

        def out(leaders: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nothing = pa.nulls(leaders.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, nothing, *leaders.columns], names=["a", "b", *_LEADER])
            if len(forest.above) > FOREST:
                yield from stars()

        def stars() -> Iterator[pa.RecordBatch]:
            found = forest.stars()
            yield pa.RecordBatch.from_arrays([*found.columns, *[pa.nulls(found.num_rows, t) for t in _LEADER.values()]], names=["a", "b", *_LEADER])

        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch]) if held.num_rows else batch
            key, part = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            other = np.flatnonzero((key != key[-1]) | (part != part[-1])) if len(key) else []
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield from out(settle(rows.slice(0, last)))
            held = rows.slice(last)
        if held is not None and held.num_rows:
            yield from out(settle(held))
        yield from stars()

    schema = "a bigint, b bigint, key bigint, rid bigint, low bigint, high bigint, reach bigint, point binary"
    found = saved(dealt.repartition("key", "part").sortWithinPartitions("key", "part", "n", "rid").mapInArrow(lean(run), schema))
    edges, leaders = found.where("a IS NOT NULL").select("a", "b"), found.where("a IS NULL").drop("a", "b")
    return edges if hot.isEmpty() else edges.unionByName(leader_edges(leaders, limits, most))


def leader_edges(leaders: DataFrame, limits: Threshold, most: int) -> DataFrame:
    """a, b: leaders of one key whose groups may hold a link between them.

    leaders: key, rid, point, low and high (sizes in the group), reach (the
    distance of its furthest member). Distances of points obey the triangle
    inequality. Leaders are dealt in blocks, and two blocks meet in one task.
    """
    blocks = leaders.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / most).alias("m"))
    own = F.pmod(F.xxhash64("rid", F.lit(9)), "m")
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    dealt = leaders.join(blocks, "key").withColumn("g", F.explode(pairs)).select("key", "g.i", "g.j", "rid", "low", "high", "reach", "point")

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), None

        def settle(rows: pa.RecordBatch) -> None:
            name = np.stack([rows.column(c).to_numpy() for c in range(3)])
            rid, low, high, reach = (rows.column(c).to_numpy() for c in range(3, 7))
            points = Points(rows.column(7))
            size = np.array([points.counts[b][r].sum(dtype=np.int64) for b, r in zip(points.bits.tolist(), points.row.tolist(), strict=True)], np.int64)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(name) != 0).any(axis=0)) + 1, [rows.num_rows]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                for k in range(a, b - 1):
                    some = np.arange(k + 1, b)
                    some = some[(low[some] <= high[k] / limits.t + 1) & (low[k] <= high[some] / limits.t + 1)]
                    apart = size[some] + size[k] - 2 * points.overlap(np.full(len(some), k), some)
                    near = some[apart <= reach[some] + reach[k] + limits.radius * (high[some] + high[k]) + 1e-6]
                    forest.add((int(rid[k]), r) for r in rid[near].tolist())

        for batch in groups:
            rows = batch if held is None else pa.concat_batches([held, batch])
            name = np.stack([rows.column(c).to_numpy() for c in range(3)])
            other = np.flatnonzero((name != name[:, -1:]).any(axis=0)) if rows.num_rows else []
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                settle(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None and held.num_rows:
            settle(held)
        yield forest.stars()

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rid").mapInArrow(lean(run), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """v, root: the smallest vertex that each vertex reaches over the edges a, b.

    Rounds of minima over neighbours with pointer jumping; each round is written
    to the shared folder and the one before it removed. Neighbours are never
    gathered in a list.
    """
    # stars of one group from many tasks have a few centres: all hang on each point's smallest one
    least = F.min("b").over(Window.partitionBy("a"))
    stars = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().withColumn("m", least)
    few = stars.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).where("e.a <> e.b").select("e.a", "e.b").distinct()
    both = saved(few.unionByName(few.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = saved(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("root"), F.lit(True).alias("moved")))
    while True:
        near = both.join(within_reach(labels), both["b"] == labels["v"]).groupBy(F.col("a").alias("w")).agg(F.min("root").alias("least"))
        step = labels.join(near, F.col("v") == F.col("w")).select("v", "root", F.least("root", "least").alias("next"))
        step = saved(step)
        jump = step.select(F.col("v").alias("u"), F.col("next").alias("far"))
        after = saved(step.join(within_reach(jump), F.col("next") == F.col("u")).select("v", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")))
        forget(labels)
        forget(step)
        labels = after
        if labels.where("moved").isEmpty():
            forget(both)
            return labels.select("v", "root")


class RTree:
    """A packed R-tree: nodes of ``FANOUT`` children with bounding maxima and least sizes, level by level."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        # points of a like size and a like projection stand together: near copies share leaves
        aim = np.random.default_rng(0).integers(-8, 9, points.shape[1])
        slab, order = FANOUT * FANOUT, np.argsort(sizes, kind="stable")
        places = points @ aim
        self.order = np.concatenate([p[np.argsort(places[p], kind="stable")] for p in (order[i : i + slab] for i in range(0, len(order), slab))])
        self.sizes, self.points = sizes, points
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        high, low = points[self.order], sizes[self.order]
        while not self.levels or len(high) > 1:
            starts = np.arange(0, len(high), FANOUT)
            high, low = np.maximum.reduceat(high, starts, axis=0), np.minimum.reduceat(low, starts)
            self.levels.append((high, low))

    def near(self, k: int, limits: Threshold, open_: np.ndarray) -> np.ndarray:
        """Open points whose bound allows a link with point ``k``, found from the root down."""
        size, centre = self.sizes[k], self.points[k]
        nodes = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            high, low = self.levels[level]
            overlap = np.minimum(high[nodes], centre).sum(axis=1, dtype=np.int64)
            nodes = nodes[limits.close(overlap, low[nodes], size)]
            below = len(self.levels[level - 1][1]) if level else len(self.order)
            nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            nodes = nodes[nodes < below]
        at = self.order[nodes]
        at = at[open_[at]]
        overlap = np.minimum(self.points[at], centre).sum(axis=1, dtype=np.int64)
        return at[limits.close(overlap, self.sizes[at], size)]


def linked(sets: list[np.ndarray], limits: Threshold) -> np.ndarray:
    """For each set the index of the first set that it reaches over verified links."""
    sizes = np.array([len(s) for s in sets], np.int64)
    tree = RTree(sizes, np.array([point(s) for s in sets]))
    open_, root = np.ones(len(sets), bool), np.arange(len(sets))
    for start in range(len(sets)):
        if not open_[start]:
            continue
        open_[start], queue = False, [start]
        while queue:
            k = queue.pop()
            for j in tree.near(k, limits, open_).tolist():
                small, large = (sets[k], sets[j]) if sizes[k] <= sizes[j] else (sets[j], sets[k])
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                if limits.links(int((large[at] == small).sum()), int(sizes[k]), int(sizes[j])):
                    open_[j], root[j] = False, start
                    queue.append(j)
    return root


def _verify(groups: DataFrame, docs: DataFrame, text: str, width: int, limits: Threshold) -> DataFrame:
    """a, b: verified links within each group, as stars.

    groups: root, i, j, rid, doc_id, text_hash; the first three name a group.
    The texts join their groups and come together in one task, a group at a time.
    """
    bodies = docs.select(F.col("doc_id").alias("d"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash"))
    _, near = by_hash(bodies, F.col("h"), groups, "text_hash")
    placed = near.join(within_reach(groups), same).select("root", "i", "j", "rid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, held = None, [], []

        def edges() -> pa.RecordBatch:
            root = linked(held, limits)
            rid = np.array(ids, np.int64)
            real = root != np.arange(len(rid))
            return pa.RecordBatch.from_arrays([pa.array(rid[real]), pa.array(rid[root[real]])], names=["a", "b"])

        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in range(4)], shingle_sets(strings(batch.column(4)), width), strict=True)
            for root, i, j, rid, shingles in rows:
                if (root, i, j) != group:
                    if len(ids) > 1:
                        yield edges()
                    group, ids, held = (root, i, j), [], []
                if not ids or ids[-1] != rid:  # a repeated row
                    ids.append(rid)
                    held.append(shingles)
        if len(ids) > 1:
            yield edges()

    ordered = placed.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "rid")
    return ordered.mapInArrow(lean(run), "a bigint, b bigint")


def verified_edges(members: DataFrame, docs: DataFrame, text: str, width: int, limits: Threshold, cluster: int = CLUSTER) -> DataFrame:
    """a, b: representatives that verified links connect, as stars.

    members: root (of the candidate cluster), rid, doc_id, text_hash, n. A cluster
    of up to ``cluster`` sets and ``LOAD`` shingles is verified at once. A larger one is verified in
    blocks; then a few sets of each part so connected are verified with each
    other, which joins the parts of a group of near copies. Only sets outside a
    cluster's largest part can still lack a link: they are verified, in blocks,
    against each other and against all blocks of that part. These blocks are up to ``LONGER``
    times as long where the cluster has more than ``BLOCKS`` of them. So no task holds
    more than about ``LONGER`` times ``cluster`` sets or ``LOAD`` shingles, and the work grows with
    what the largest part leaves over.
    """
    half, names = cluster // 2, ["root", "i", "j", "rid", "doc_id", "text_hash"]
    weight = F.greatest(F.count(F.lit(1)), F.ceil(F.sum("n") * cluster / LOAD))
    sizes = members.groupBy("root").agg(weight.alias("m"))
    dealt = members.join(sizes, "root")
    zero = F.lit(0).cast("bigint")
    block = lambda n, salt: F.pmod(F.xxhash64("rid", F.lit(salt)), F.ceil(n / F.lit(half)))
    first = dealt.withColumn("i", F.when(F.col("m") <= cluster, zero).otherwise(block(F.col("m"), 1))).withColumn("j", zero)
    edges = saved(_verify(saved(first.select(names)), docs, text, width, limits))
    large = saved(dealt.where(F.col("m") > cluster).drop("m"))
    if large.isEmpty():
        return edges
    parts = lambda e: large.join(components(e).select(F.col("v").alias("rid"), F.col("root").alias("p")), "rid", "left").withColumn("part", F.coalesce("p", "rid")).drop("p")
    some = [F.min("rid"), F.max("rid"), *[F.min_by("rid", F.xxhash64("rid", F.lit(k))) for k in (2, 3)]]
    chosen = parts(edges).groupBy("root", "part").agg(F.count(F.lit(1)).alias("c"), F.array_distinct(F.array(*some)).alias("x"))
    chosen = chosen.where("c > 1").select("root", F.explode("x").alias("rid"))
    few = chosen.join(large, ["root", "rid"])
    few = few.join(few.groupBy("root").agg(weight.alias("m")), "root")
    few = few.withColumn("i", F.when(F.col("m") <= cluster, zero).otherwise(block(F.col("m"), 4))).withColumn("j", zero)
    edges = saved(edges.unionByName(_verify(saved(few.select(names)), docs, text, width, limits)))

    left = saved(parts(edges))
    counts = left.groupBy("root", "part").agg(weight.alias("c"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("l"))
    main = counts.groupBy("root").agg(F.max(F.struct("c", "part", "k", "l")).alias("x"), F.sum("k").alias("k"), F.sum("l").alias("l"))
    longest = F.least(F.greatest(F.ceil(F.col("k") / BLOCKS), F.lit(half)), F.lit(LONGER * half))
    blocks = lambda k, n: F.greatest(F.ceil(k / longest), F.ceil(2 * n / LOAD))
    main = main.select("root", F.col("x.part").alias("main"), blocks(F.col("x.k"), F.col("x.l")).alias("nd"), blocks(F.col("k") - F.col("x.k"), F.col("l") - F.col("x.l")).alias("ns"))
    # blocks of the rest are numbered from 0, blocks of the largest part from -1 down
    rest = left.join(main.where("ns > 0"), "root").withColumn("rest", F.col("part") != F.col("main"))
    own = F.pmod(F.xxhash64("rid", F.lit(5)), F.when(F.col("rest"), F.col("ns")).otherwise(F.col("nd")))
    upto = lambda n: F.sequence(zero, F.col(n) - 1)
    others = F.concat(
        F.transform(upto("ns"), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"))),
        F.transform(upto("nd"), lambda k: F.struct(F.col("own").alias("i"), (-1 - k).alias("j"))),
    )
    of_main = F.transform(upto("ns"), lambda k: F.struct(k.alias("i"), (-1 - F.col("own")).alias("j")))
    pairs = rest.withColumn("own", own).select("root", "rid", "doc_id", "text_hash", F.explode(F.when(F.col("rest"), others).otherwise(of_main)).alias("g"))
    pairs = saved(pairs.select("root", F.col("g.i").alias("i"), F.col("g.j").alias("j"), "rid", "doc_id", "text_hash"))
    return edges if pairs.isEmpty() else edges.unionByName(_verify(pairs, docs, text, width, limits))


def ngram_join(docs: DataFrame, text: str = "text", width: int = 3, percent: int = 90, cluster: int = CLUSTER, keys: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    With ``keys`` also text_hash and kept: of each component the rows of one
    doc_id and text are kept, the smallest doc_id, then the smallest hash.

    docs: doc_id and a string column named by ``text``; other columns are
    ignored. Two rows link when 100 * intersection >= percent * union of their
    sets of distinct ``width``-word shingles. component_id is the smallest doc_id
    that a row reaches over links, its own included. Null and empty texts and
    texts without words have an empty set and link with nothing. Repeated rows
    link like any equal texts. A null doc_id is never the smallest; a component
    of null ids alone has a null component_id.
    """
    bound_batches(docs.sparkSession)
    limits = Threshold(percent)
    given = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    every = saved(signatures(given, "text", width, limits, frequent_shingles(given, "text", width)))
    full = every.where(F.col("n") > 0)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "rid"))
    rows = full.groupBy("set_hash").agg(first.alias("first"), F.first("n").alias("n"))
    classes = saved(rows.select("first.rid", "set_hash", "first.doc_id", "first.text_hash", "n"))
    copies = saved(full.select("rid").join(classes.select("rid"), "rid", "left_anti"))
    reps = full.select("rid", "n", "point", "prefix", "common").join(within_reach(copies, COPIES), "rid", "left_anti")
    first = F.col("n") + 1 - F.ceil(F.col("n") * (2 * percent) / (100 + percent))
    several = shared_keys(reps.select("n", "rid", first.alias("most"), F.posexplode("prefix").alias("place", "key")).select("n", "rid", "key", (F.col("place") <= F.col("most")).alias("inner")), limits)
    several = saved(several.unionByName(reps.select("n", "rid", F.explode("common").alias("key"))))
    clusters = components(candidate_edges(several, full.select("rid", "point"), limits))
    members = saved(clusters.join(classes.select("rid", "doc_id", "text_hash", "n"), F.col("v") == F.col("rid")).select("root", "rid", "doc_id", "text_hash", "n"))
    forget(several)
    joined = components(verified_edges(members, given, "text", width, limits, cluster))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    least = joined.join(classes.select("rid", place.alias("own")), F.col("v") == F.col("rid")).groupBy("root").agg(F.min("own").alias("least"))
    known = joined.join(least, "root").select(F.col("v").alias("rid"), "least")
    of_class = classes.join(known, "rid", "left").select("set_hash", F.coalesce("least", place).alias("least"))
    found = full.select("doc_id", "text_hash", "n", "set_hash").join(of_class, "set_hash")
    empty = every.where(F.col("n") == 0).select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_hash", F.lit(True).alias("kept"))
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    out = found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), "text_hash", kept.alias("kept")).unionByName(empty)
    return out if keys else out.drop("text_hash", "kept")
