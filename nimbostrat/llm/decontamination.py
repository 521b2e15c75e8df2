"""Benchmark decontamination by greedy string tiling.

The words of the test items are given ids, and every run of ``MIN_MATCH`` words
of an item is a seed, found by a rolling Karp-Rabin hash.  Each text looks up its
own runs among the seeds and compares the words; neighbouring seeds on one
diagonal are a maximal match.  Per text and item, the longest matches are marked
first, again and again, never overlapping in either text, down to seed length.
An item leaks into a text where the tiles cover at least ``COVERAGE`` of the item,
in whatever order they stand.

The items go to the executors in blocks of a bounded number of words.  More than
one block means a pass over the texts for each, one block alive at a time; a pass
keeps only the texts with a leak.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbostrat.llm.common import bound_batches, fresh, lean, mix64, saved, strings, within_reach

MIN_MATCH = 5
COVERAGE = 0.8
#: Words of test items in one block, about 100 bytes each once indexed.
BLOCK_WORDS = 2_000_000

#: Seed matches expanded at once.
PAIRS = 1 << 20

_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))


def words_of(text: str) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return _WORD.findall(text.lower())


def run_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size`` word ids, rolled: the next one drops a word and takes one in."""
    if len(ids) < size:
        return np.zeros(0, np.uint64)
    # h(i) = sum of id(i + k) * B^-(i + k), scaled by B^i: the running sums roll modulo 2^64
    steps = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(ids), _INVERSE)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(ids), _BASE)]))
    sums = np.concatenate([[np.uint64(0)], np.add.accumulate(ids * steps[:-1])])
    return mix64((sums[size:] - sums[:-size]) * back[: len(ids) - size + 1])


def merged(runs: np.ndarray) -> np.ndarray:
    """Rows (diagonal, first, last text position of seeds), those that touch joined."""
    if not len(runs):
        return runs
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    new = np.concatenate([[True], (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] > runs[:-1, 2] + 1)])
    starts = np.flatnonzero(new)
    return np.stack([runs[starts, 0], runs[starts, 1], np.maximum.reduceat(runs[:, 2], starts)], axis=1)


def tiles(runs: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (text position, item position, words), longest first.

    runs: rows of ``merged``; a seed at text position i on diagonal i - j is a
    match of ``least`` words. Of equally long matches the one that starts first in
    the item is marked, then the one that starts first in the text. A match that
    overlaps a tile goes on with the parts that the tiles leave free.
    """
    found: list[tuple[int, int, int]] = []
    heap = [(-(last - first + least), first - d, first) for d, first, last in runs.tolist()]
    heapq.heapify(heap)
    text, item = _Free(), _Free()
    while heap:
        n, j, i = heapq.heappop(heap)
        n = -n
        free = [(max(a, b), min(c, d)) for a, c in text.gaps(i, i + n) for b, d in ((x + i - j, y + i - j) for x, y in item.gaps(j, j + n)) if min(c, d) - max(a, b) >= least]
        if free == [(i, i + n)]:
            found.append((i, j, n))
            text.mark(i, i + n)
            item.mark(j, j + n)
        else:
            for a, c in free:
                heapq.heappush(heap, (-(c - a), a - i + j, a))
    return found


class _Free:
    """Marked ranges, apart and in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def mark(self, a: int, b: int) -> None:
        k = bisect.bisect(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)

    def gaps(self, a: int, b: int) -> list[tuple[int, int]]:
        """What is not marked between ``a`` and ``b``."""
        out, k = [], bisect.bisect(self.ends, a)
        while a < b:
            if k == len(self.starts) or self.starts[k] >= b:
                out.append((a, b))
                break
            if self.starts[k] > a:
                out.append((a, self.starts[k]))
            a = self.ends[k]
            k += 1
        return out


class ItemIndex:
    """The words of a block of test items one after the other, and their sorted seed hashes.

    Items are numbered by place, as ids may repeat or be null.
    """

    def __init__(self, items: list[tuple[int | None, str]], least: int):
        self.least, self.vocabulary, self.item_ids = least, {}, [item_id for item_id, _ in items]
        every = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.uint64) for _, text in items]
        self.lengths = np.array([len(ids) for ids in every], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.words = np.concatenate([*every, np.zeros(0, np.uint64)])
        self.owner = np.repeat(np.arange(len(every)), self.lengths)
        # an item shorter than a seed is matched whole
        self.sizes = sorted({min(least, n) for n in self.lengths.tolist() if n})
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in self.sizes:
            own = [self.starts[k] + np.arange(n - size + 1) for k, n in enumerate(self.lengths.tolist()) if n and min(least, n) == size]
            hashes = np.concatenate([run_hashes(every[k], size) for k, n in enumerate(self.lengths.tolist()) if n and min(least, n) == size])
            order = np.argsort(hashes, kind="stable")
            self.seeds[size] = hashes[order], np.concatenate(own)[order]

    def _pairs(self, ids: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Verified seed matches (positions in the text, in ``words``), some at a time."""
        keys, places = self.seeds[size]
        whole = np.convolve(ids != 0, np.ones(size, np.int64), "valid") == size if len(ids) >= size else np.zeros(0, bool)
        at = np.flatnonzero(whole)
        if not len(at):
            return
        h = run_hashes(ids, size)[at]
        first, last = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        at, first, count = at[last > first], first[last > first], (last - first)[last > first]
        ends = np.cumsum(count)
        k = 0
        while k < len(at):
            stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
            i = np.repeat(at[k:stop], count[k:stop])
            offset = np.arange(len(i)) - np.repeat(np.cumsum(count[k:stop]) - count[k:stop], count[k:stop])
            g = places[np.repeat(first[k:stop], count[k:stop]) + offset]
            same = np.ones(len(i), bool)
            for x in range(size):
                same &= ids[i + x] == self.words[g + x]
            yield i[same], g[same]
            k = stop

    def leaks(self, text: str, coverage: float) -> list[tuple[int | None, float, int]]:
        """(item, covered share, tiles) of all items that leak into a text."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words_of(text)], np.uint64)
        out = []
        for size in self.sizes:
            matched: list[np.ndarray] = []
            for i, g in self._pairs(ids, size):
                own = self.owner[g]
                rows = np.stack([own, i - g, i], axis=1)
                rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
                if len(rows):
                    new = np.flatnonzero(np.concatenate([[True], (np.diff(rows[:, :2], axis=0) != 0).any(axis=1) | (np.diff(rows[:, 2]) != 1)]))
                    matched.append(np.concatenate([rows[new], rows[np.concatenate([new[1:] - 1, [len(rows) - 1]])][:, 2:]], axis=1))
            every = np.concatenate(matched) if matched else np.zeros((0, 4), np.int64)
            for owner in np.unique(every[:, 0]).tolist():
                length, start = int(self.lengths[owner]), int(self.starts[owner])
                runs = merged(every[every[:, 0] == owner, 1:] + [start, 0, 0])
                # no tiles can cover more than all matches together
                reached = np.zeros(length + 1, np.int64)
                np.add.at(reached, runs[:, 1] - runs[:, 0], 1)
                np.add.at(reached, runs[:, 2] - runs[:, 0] + size, -1)
                if (np.cumsum(reached)[:-1] > 0).sum() < coverage * length:
                    continue
                marked = tiles(runs, size)
                share = sum(n for _, _, n in marked) / length
                if share >= coverage:
                    out.append((self.item_ids[owner], share, len(marked)))
        return sorted(out, key=lambda x: (-x[1], x[0] is None, x[0] or 0, x[2]))


def _blocks(items: DataFrame, text: str, limit: int) -> Iterator[list[tuple[int | None, str]]]:
    """Items in id order, in blocks of about ``limit`` words; the driver holds one block."""
    block, size = [], 0
    for row in items.select("item_id", F.col(text).alias("text")).where(F.col(text).isNotNull()).distinct().orderBy("item_id", "text").toLocalIterator():
        n = len(row["text"]) // 2 + 1
        if block and size + n > limit * 3:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += n
    yield block


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", coverage: float = COVERAGE, least: int = MIN_MATCH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_items, item_id, coverage, n_tiles, contaminated.

    docs: any table with a string column named by ``text``; columns with the
    names of the results are replaced, all others pass through. items: item_id
    and a text; an item without words or of null text matches nothing. Each
    distinct pair of item_id, which may be null, and text is an item of its own.
    item_id, coverage and n_tiles are of the item covered most (the smallest id
    among equals, null last), null and 0 where none leaks. Null and empty texts
    are clean. Repeated rows are judged one by one.
    """
    bound_batches(docs.sparkSession)
    names = ["n_items", "item_id", "coverage", "n_tiles"]
    body, state = fresh("text"), fresh("leaks")
    kept = [c for c in docs.columns if c not in (*names, "contaminated")]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(body))
    blocks = _blocks(items, item_text, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        out = _pass(out, body, ItemIndex(first, least), coverage, state)
    else:
        # one block alive at a time; texts are known again by their digests
        key, parts = fresh("digest"), []
        out = out.withColumn(key, F.md5(F.coalesce(body, F.lit("")).cast("binary")))
        for block in itertools.chain([first, second], blocks):
            parts.append(saved(_pass(out.select(key, body), body, ItemIndex(block, least), coverage, state, leaks_only=True).select(key, state).distinct()))
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        order = F.struct(-F.col(f"{state}.coverage"), F.col(f"{state}.item_id").isNull(), F.col(f"{state}.item_id"), F.col(f"{state}.n_tiles"))
        best = every.groupBy(key).agg(F.sum(f"{state}.n").cast("int").alias("n"), F.min_by(state, order).alias("best"))
        best = saved(best.select(key, F.struct("n", "best.item_id", "best.coverage", "best.n_tiles").alias(state)))
        out = out.join(within_reach(best), key, "left")
    n = F.coalesce(F.col(f"{state}.n"), F.lit(0))
    return out.select(
        *[F.col(f"`{c}`") for c in kept],
        n.alias("n_items"),
        F.col(f"{state}.item_id").alias("item_id"),
        F.coalesce(F.col(f"{state}.coverage"), F.lit(0.0)).alias("coverage"),
        F.coalesce(F.col(f"{state}.n_tiles"), F.lit(0)).alias("n_tiles"),
        (n > 0).alias("contaminated"),
    )


def _pass(docs: DataFrame, body: str, index: ItemIndex, coverage: float, state: str, leaks_only: bool = False) -> DataFrame:
    """One block of items against all rows; adds a struct column, or keeps only the rows with a leak."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.struct([("n", pa.int32()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows = []
            for one in strings(batch.column(body)).to_pylist():
                found = index.leaks(one, coverage)
                rows.append({"n": len(found), "item_id": found[0][0], "coverage": found[0][1], "n_tiles": found[0][2]} if found else {"n": 0, "item_id": None, "coverage": None, "n_tiles": None})
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, state])
            yield out.filter(pa.array([r["n"] > 0 for r in rows], pa.bool_())) if leaks_only else out

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(lean(run), ", ".join([*fields, f"`{state}` struct<n:int,item_id:bigint,coverage:double,n_tiles:int>"]))
