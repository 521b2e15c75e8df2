"""Line deduplication with a log-template tree.

Every line is parsed into words; words with a decimal digit become wildcards.  The
tree has a fixed depth: the number of words, then the leading words; a leaf holds the
lines that agree in both.  Within a leaf a line's words are ranked by how many of the leaf's lines
have the same word at the same place, the rarest first.  Its templates are the line as
it is, and the line with its rarest words open, up to a share ``1 - SIMILARITY`` of
all; words of equal rank are opened together.  Lines that differ in any number
of fields, wherever they are, so share a template: the words that they agree on are
more frequent than what they differ in.  Lines of which a template occurs in at least
``min_docs`` documents are dropped everywhere.

No task holds a leaf.  Ranks are counts by (leaf, place, word) and templates are
hashes, so both are aggregations with partial sums on the map side; frequent keys
meet their counts by broadcast, the others by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbostrat.llm.common import bound_batches, forget, fresh, join_spread, mix64, saved, spread_from, strings
from nimbostrat.llm.ngram_join import word_hashes

DEPTH = 3
SIMILARITY = 0.7
MIN_DOCS = 10
#: Characters of text parsed together.
CHUNK_CHARS = 1 << 22
#: Leaves, 8 bytes each, by which tasks leave other lines out early; with more, lines meet them by a join.
KNOWN_LEAVES = 1_000_000

_WIDTH, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WILDCARD, _OPEN = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xA0761D6478BD642F)


def places(n: np.ndarray) -> np.ndarray:
    """0, 1, 2 and so on within each of some lists of ``n`` elements."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of neighbouring lists of ``n`` values, modulo 2^64."""
    total = np.concatenate([[np.uint64(0)], np.add.accumulate(values, dtype=np.uint64)])
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


def placed(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A word at a place."""
    return words * (mix64(at.astype(np.uint64) + _PLACE) | np.uint64(1))


class Lines:
    """The lines of some texts: text and place of each, its words' hashes and its leaf."""

    def __init__(self, texts: pa.Array, depth: int):
        split = pc.split_pattern(texts, "\n")
        row = pc.list_parent_indices(split).to_numpy()
        counts = pc.list_value_length(split).to_numpy()
        words = pc.utf8_split_whitespace(pc.list_flatten(split))
        owner, flat = pc.list_parent_indices(words), pc.list_flatten(words)
        real = pc.greater(pc.binary_length(flat), 0)
        owner, flat = owner.filter(real).to_numpy(), flat.filter(real)
        coded = flat.dictionary_encode()
        digits = pc.match_substring_regex(coded.dictionary, r"\p{Nd}").to_numpy(zero_copy_only=False)
        hashes = word_hashes(coded)
        if len(hashes):
            hashes[digits[coded.indices.to_numpy(zero_copy_only=False)]] = _WILDCARD
        n = np.bincount(owner, minlength=len(row)).astype(np.int64)
        some = np.flatnonzero(n)  # lines without words have no leaf
        self.row, self.place, self.n, self.words = row[some], places(counts)[some], n[some], hashes
        at = places(self.n)
        self.leaf = mix64(_sums(np.where(at < depth, placed(hashes, at), np.uint64(0)), self.n) + self.n.astype(np.uint64) * _WIDTH).view(np.int64)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Neighbouring texts of about ``CHUNK_CHARS`` bytes, and the place of the first."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start = 0
    while start < len(texts):
        end, total = start + 1, sizes[start]
        while end < len(texts) and total + sizes[end] <= CHUNK_CHARS:
            total += sizes[end]
            end += 1
        yield start, texts.slice(start, end - start)
        start = end


def frequent_leaves(texts: DataFrame, text: str, least: int, depth: int) -> DataFrame:
    """leaf: those of at least ``least`` lines, each counted once a row; a saved table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in _chunks(strings(batch.column(0))):
                lines = Lines(part, depth)
                order = np.lexsort((lines.leaf, lines.row))
                row, leaf = lines.row[order], lines.leaf[order]
                first = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(leaf) != 0)])[: len(leaf)]
                yield pa.RecordBatch.from_arrays([pa.array(leaf[first])], names=["leaf"])

    return saved(texts.select(text).mapInArrow(run, "leaf bigint").groupBy("leaf").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).select("leaf"))


def lines_of(docs: DataFrame, key: str, text: str, leaves: DataFrame, depth: int) -> DataFrame:
    """key, place, leaf, words (hashes): the lines in some leaves, of a saved table."""
    few = leaves.limit(KNOWN_LEAVES + 1).count() <= KNOWN_LEAVES
    known = np.sort(np.array([r["leaf"] for r in leaves.toLocalIterator()], np.int64)) if few else None
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for start, part in _chunks(strings(batch.column(1))):
                lines = Lines(part, depth)
                if known is None:
                    hit = np.ones(len(lines.leaf), bool)
                elif len(known):
                    hit = known[np.minimum(np.searchsorted(known, lines.leaf), len(known) - 1)] == lines.leaf
                else:
                    hit = np.zeros(len(lines.leaf), bool)
                offsets = np.concatenate([[0], np.cumsum(lines.n[hit])]).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(lines.words[np.repeat(hit, lines.n)].view(np.int64)))
                at = batch.column(0).take(pa.array(lines.row[hit] + start))
                yield pa.RecordBatch.from_arrays([at, pa.array(lines.place[hit].astype(np.int32)), pa.array(lines.leaf[hit]), words], names=[key, "place", "leaf", "words"])

    out = docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, place int, leaf bigint, words array<bigint>")
    return out if few else out.join(leaves, "leaf", "left_semi")


def templates(words: np.ndarray, counts: np.ndarray, n: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(line, template) pairs of lines of ``n`` words with the counts of these in their leaf.

    A line is opened at its rarest words as long as the next one is more frequent and
    the open ones are at most a share ``1 - similarity``.
    """
    line, at = np.repeat(np.arange(len(n)), n), places(n)
    parts = placed(words, at)
    whole = _sums(parts, n) + n.astype(np.uint64) * _WIDTH
    order = np.lexsort((at, counts, line))
    change = mix64(at.astype(np.uint64) + _OPEN)[order] - parts[order]
    total = np.concatenate([[np.uint64(0)], np.add.accumulate(change, dtype=np.uint64)])
    rank, ranked = at, counts[order]  # places within a line are also the ranks in its order
    begin = (np.cumsum(n) - n)[line]
    most = ((1 - similarity) * n + 1e-9).astype(np.int64)[line]
    ends = np.flatnonzero((rank + 1 <= most) & (rank + 1 < n[line]) & (ranked < np.append(ranked[1:], 0)))
    opened = whole[line[ends]] + total[ends + 1] - total[begin[ends]]
    return np.concatenate([np.arange(len(n)), line[ends]]), mix64(np.concatenate([whole, opened])).view(np.int64)


def line_templates(lines: DataFrame, key: str, similarity: float) -> DataFrame:
    """key, place, template: the templates of saved lines with an id, ranked by all of them."""
    each = lines.select("id", key, "place", "leaf", F.posexplode("words").alias("at", "word")).withColumn("slot", F.xxhash64("leaf", "at", "word"))
    counts = saved(each.groupBy("slot").agg(F.count(F.lit(1)).alias("c")).withColumnRenamed("slot", "counted"))
    total = counts.agg(F.sum("c")).first()[0] or 0
    ranked = join_spread(each, ["slot"], counts, ["counted"], "c", spread_from(total))
    whole = ranked.groupBy("id").agg(F.first(key).alias(key), F.first("place").alias("place"), F.sort_array(F.collect_list(F.struct("at", "word", "c"))).alias("x")).select(key, "place", F.col("x.word").alias("words"), F.col("x.c").alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            line, template = templates(batch.column(2).flatten().to_numpy().view(np.uint64), batch.column(3).flatten().to_numpy(), n, similarity)
            at = pa.array(line)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(template)], names=[key, "place", "template"])

    return whole.mapInArrow(run, f"`{key}` {lines.schema[key].dataType.simpleString()}, place int, template bigint")


def recurring_lines(docs: DataFrame, key: str, text: str, min_docs: int, depth: int, similarity: float) -> DataFrame:
    """key, places: the lines of each document of which a template occurs in at least ``min_docs`` documents."""
    leaves = frequent_leaves(docs, text, min_docs, depth)
    lines = saved(lines_of(docs, key, text, leaves, depth).withColumn("id", F.monotonically_increasing_id()))
    found = saved(line_templates(lines, key, similarity))
    often = found.select("template", key).distinct().groupBy("template").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") >= min_docs)
    rows = found.groupBy("template").agg(F.count(F.lit(1)).alias("c"))
    often = saved(often.join(rows, "template").select(F.col("template").alias("known"), "c"))
    total = often.agg(F.sum("c")).first()[0] or 0
    hit = join_spread(found, ["template"], often, ["known"], "c", spread_from(total))
    gone = saved(hit.groupBy(key).agg(F.collect_set("place").alias("places")))
    for table in (leaves, lines, found, often):
        forget(table)
    return gone


def drop_recurring_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, depth: int = DEPTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, text.

    docs: doc_id and a string column named by ``text``; other columns are
    ignored. Lines end at a line feed. Lines without words are kept. A null text
    counts as empty, one empty line. Documents are told apart by an MD5 of doc_id and
    text: a repeated row is the same document again and gets the same result.
    There are no ties: a line goes if any of its templates recurs. Leaves, words and
    templates are told apart by 64 bits.
    """
    bound_batches(docs.sparkSession)
    key, body, dropped = fresh("key"), fresh("text"), fresh("dropped")
    given = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias(body))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col(body))
    given = given.withColumn(key, F.unhex(F.md5(name.cast("binary"))))
    gone = recurring_lines(given, key, body, min_docs, depth, similarity).withColumnRenamed(key, dropped)
    out = given.join(gone, F.col(key) == F.col(dropped), "left")
    every, places_ = F.split(F.col(body), "\n", -1), F.coalesce("places", F.array().cast("array<int>"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
    kept = F.when(F.col("places").isNull(), F.col(body)).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    out = out.withColumn("lines", every)
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size(places_).cast("long").alias("n_dropped"), kept.alias("text"))
