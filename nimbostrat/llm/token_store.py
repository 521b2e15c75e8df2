"""Token ids on disk as one wavelet matrix per shard.

Documents are range-partitioned by doc_id and encoded; runs of about
``SHARD_TOKENS`` ids become shards.  A shard is one row of a Parquet file with
zstd pages: the bit-planes of its ids from the highest bit down, with counts of
set bits at every 512th position.  Between planes the ids are stably parted,
zeros first, so that any id is read, counted or located from the planes alone.
Spark's own writer commits the files, so a lost executor leaves no half shard.

Row format: ``part`` (range partition, in doc_id order), ``seq`` (shard within
it), ``doc_ids`` and ``lengths`` (arrays, a document's ids with its end id),
``n_tokens``, ``planes`` (packed bits, high bit of a byte first), ``marks``
(little-endian unsigned 32-bit running counts of ones, one per 512 bits),
``zeros`` (zero bits of each plane).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nimbostrat.llm.common import BROADCAST_ROWS, bound_batches, lean, shared_folder, strings
from nimbostrat.llm.tokens import as_bytes, encoder, ids_batch

SHARD_TOKENS = 1 << 21
MARK = 512
SCHEMA = (
    "part int, seq int, doc_ids array<bigint>, lengths array<bigint>, n_tokens bigint, "
    "planes array<binary>, marks array<binary>, zeros array<bigint>"
)


class WaveletMatrix:
    """Bit-planes of a sequence of ids with rank and select."""

    def __init__(self, n: int, planes: list[bytes], marks: list[bytes], zeros: list[int]):
        self.n, self.zeros = n, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.marks = [np.frombuffer(m, "<u4") for m in marks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, marks, zeros = [], [], []
        for b in range(bits - 1, -1, -1):
            bit = (ids & ids.dtype.type(1 << b)) != 0
            packed = np.packbits(bit)
            ones = np.bitwise_count(packed)
            cut = np.concatenate([[0], np.add.reduceat(ones, np.arange(0, len(ones), MARK // 8), dtype=np.int64)]) if len(ones) else np.zeros(1)
            planes.append(packed.tobytes())
            marks.append(np.cumsum(cut).astype("<u4").tobytes())
            zeros.append(len(ids) - int(np.count_nonzero(bit)))
            if b:
                ids = np.concatenate([np.compress(~bit, ids), np.compress(bit, ids)])
        return cls(len(ids), planes, marks, zeros)

    def parts(self) -> tuple[list[bytes], list[bytes], list[int]]:
        return [p.tobytes() for p in self.planes], [m.tobytes() for m in self.marks], self.zeros

    def decode(self) -> np.ndarray:
        """All ids in order, from the lowest plane up."""
        bits = len(self.planes)
        kind = np.uint16 if bits <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for level in range(bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            before, z = np.empty(self.n, kind), self.zeros[level]
            before[~bit] = ids[:z]
            before[bit] = ids[z:] | kind(1 << (bits - 1 - level))
            ids = before
        return ids

    def ones(self, level: int, i: int) -> int:
        """Set bits among the first ``i`` of a plane."""
        block = i // MARK
        start = block * MARK // 8
        full, rest = i // 8, i % 8
        count = int(self.marks[level][block]) + int(np.bitwise_count(self.planes[level][start:full]).sum())
        return count + (int(self.planes[level][full]) >> (8 - rest)).bit_count() if rest else count

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        value = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[i // 8]) >> (7 - i % 8) & 1
            ones = self.ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            a, b = self.ones(level, start), self.ones(level, end)
            if value >> (len(self.planes) - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` before position ``i``."""
        if value >> len(self.planes):
            return 0
        start, end = self._range(value, 0, i)
        return end - start

    def _find(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        marks = self.marks[level].astype(np.int64)
        if not bit:
            marks = np.minimum(np.arange(len(marks)) * MARK, self.n) - marks
        block = int(np.searchsorted(marks, k, "right")) - 1
        at = block * MARK
        some = np.unpackbits(self.planes[level][at // 8 : (at + MARK) // 8])[: self.n - at]
        return at + int(np.flatnonzero(some == bit)[k - int(marks[block])])

    def select(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``value``."""
        start, end = self._range(value, 0, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        at = start + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - level) & 1
            at = self._find(level, bit, at - self.zeros[level] if bit else at)
        return at


def folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares."""
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"


def id_bits(vocabulary: str, end_id: int) -> tuple[int, str]:
    """Planes that the ids need, and the NumPy type that holds an id."""
    size = encoder(vocabulary, "lengths", len).tokenizer.get_vocab_size()
    bits = max(size - 1, end_id, 1).bit_length()
    return bits, "<u2" if bits <= 16 else "<u4"


def write_tokens(docs: DataFrame, vocabulary: str, out: str, text: str = "text", end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``docs`` in ascending doc_id order and write the shards to ``out``.

    vocabulary: a vocabulary file as ``tokens.PieceEncoder`` takes it.
    A null text counts as empty and gives ``end_id`` alone. Rows that repeat a
    doc_id stay next to each other, ordered by text; null ids come first. A
    document is never cut: one longer than a shard has a shard of its own. An
    empty table writes no shard. Further columns are ignored.
    """
    bound_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit("")).alias("text")
    ordered = docs.select("doc_id", body).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, kind = id_bits(vocabulary, end_id)
        enc = encoder(vocabulary, kind, as_bytes(kind))
        end = np.array([end_id], kind)
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids, bodies, lengths, size = [], [], [], 0

        def shard() -> pa.RecordBatch:
            ids = np.concatenate(bodies)
            planes, marks, zeros = WaveletMatrix.build(ids, bits).parts()
            row = {"part": part, "seq": seq, "doc_ids": doc_ids, "lengths": lengths, "n_tokens": len(ids), "planes": planes, "marks": marks, "zeros": zeros}
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in batches:
            ids, counts = ids_batch(strings(batch.column(1)), enc, kind)
            at = 0
            for doc_id, n in zip(batch.column(0).to_pylist(), counts.tolist(), strict=True):
                if size and size + n + 1 > shard_tokens:
                    yield shard()
                    doc_ids, bodies, lengths, size, seq = [], [], [], 0, seq + 1
                doc_ids.append(doc_id)
                bodies += [ids[at : at + n], end]
                lengths.append(n + 1)
                at, size = at + n, size + n + 1
        if size:
            yield shard()

    ordered.mapInArrow(lean(run), SCHEMA).write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(out)


ARROW = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_tokens", pa.int64())]
    + [("planes", pa.list_(pa.binary())), ("marks", pa.list_(pa.binary())), ("zeros", pa.list_(pa.int64()))]
)


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], row["planes"], row["marks"], row["zeros"])


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards of ``path``, one row each."""
    return spark.read.schema(SCHEMA).parquet(path)


def shard_starts(rows: DataFrame) -> DataFrame:
    """part, seq, shard_start: the ids of all shards before each.

    Running sums go over the shards within a range partition and over the
    partitions, never over documents.
    """
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("of_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("of_part").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seqs = rows.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("seq_start"))
    return seqs.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("shard_start"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the decoded planes: doc_id, start, n_tokens, ids_crc32.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers.
    """
    rows = shards(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = _matrix(row).decode().astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                raw = memoryview(ids).cast("B")
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), row["lengths"], strict=True)]
                same = [pa.array([row[c]] * len(sums), pa.int32()) for c in ("part", "seq")]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())],
                    names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    decoded = rows.mapInArrow(lean(run), "part int, seq int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    starts = shard_starts(rows)
    if rows.count() <= BROADCAST_ROWS:  # of shards; the documents then stay where they are
        starts = F.broadcast(starts)
    return decoded.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ``ids``, each document's ids with its end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = _matrix(row).decode().astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(row["lengths"])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["doc_id", "ids"]
                )

    return shards(spark, path).mapInArrow(run, "doc_id bigint, ids array<bigint>")


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """part, seq, n, positions (within the shard) of one id, by rank and select alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                matrix = _matrix(row)
                n = matrix.rank(token, matrix.n)
                found.append({"part": row["part"], "seq": row["seq"], "n": n, "positions": [matrix.select(token, i) for i in range(n)]})
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int64()), ("positions", pa.list_(pa.int64()))]))

    return shards(spark, path).mapInArrow(run, "part int, seq int, n bigint, positions array<bigint>")


def token_output(docs: DataFrame, vocabulary: str, text: str = "text", out: str | None = None) -> DataFrame:
    """Write the ids of ``docs`` and return ``read_index`` of the files."""
    out = out or folder(docs.sparkSession)
    write_tokens(docs, vocabulary, out, text)
    return read_index(docs.sparkSession, out)
