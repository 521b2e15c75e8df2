"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FRESH = itertools.count()

# Bytes of one Arrow batch handed to a Python function; long texts make it the
# binding limit rather than the number of rows.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes, so that very long texts can't pile up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; at its end the worker, which Spark keeps for other tasks, gives free memory back to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def fresh(prefix: str) -> str:
    """A column name that can't clash with a caller's columns."""
    return f"__{prefix}_{next(_FRESH)}"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only in local mode, as in tests, it may be unset; then it is below the warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to a table in the shared folder and read again.

    That cuts its lineage and survives the loss of executors.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    for scope in _SCOPES:
        scope.append(path)
    return out


_PATHS: dict[int, str] = {}
_SCOPES: list[list[str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def forget(table: DataFrame) -> None:
    """Remove a table of ``saved`` that nothing will read any more."""
    if path := _PATHS.pop(id(table), None):
        _remove(table.sparkSession, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, saved; the tables saved on the way to it are removed."""
    _SCOPES.append(own := [])
    try:
        out = saved(make())
    finally:
        _SCOPES.pop()
    for path in own[:-1]:
        _remove(spark, path)
    return out


#: Rows of ids that are broadcast at most, about 32 bytes each.
BROADCAST_ROWS = 200_000


def within_reach(ids: DataFrame, rows: int | None = None) -> DataFrame:
    """A saved table of ids, marked for broadcast where it has at most ``rows`` (``BROADCAST_ROWS``).

    Beyond that the join shuffles both sides as usual.
    """
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(ids) if ids.limit(rows + 1).count() <= rows else ids


#: Hashes that are broadcast at most, 8 bytes each.
BROADCAST_HASHES = 2_000_000


def by_hash(rows: DataFrame, own: Column, ids: DataFrame, name: str) -> tuple[DataFrame | None, DataFrame]:
    """``rows`` whose hash ``own`` isn't in the column ``name`` of ``ids``, and the others, which alone can meet ids.

    ids: a saved table. Where it is too large for ``within_reach``, a join with it would shuffle whole
    rows; its hashes alone are still broadcast, and only the rows that have one need that join.
    Of a table that is within reach, or of more than ``BROADCAST_HASHES``, (None, rows).
    """
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return None, rows
    known = fresh("hash")
    hashes = saved(ids.select(F.col(name).alias(known)).distinct())
    if hashes.count() > BROADCAST_HASHES:
        return None, rows
    return rows.join(F.broadcast(hashes), own == F.col(known), "left_anti"), rows.join(F.broadcast(hashes), own == F.col(known), "left_semi")


#: Rows of a key from which its partner is broadcast, at least; and such keys at most.
SPREAD_ROWS, SPREAD_KEYS = 1000, 4096


def spread_from(rows: int) -> int:
    """From how many rows on a key counts as frequent: at most ``SPREAD_KEYS`` keys of ``rows`` rows can reach it."""
    return max(SPREAD_ROWS, rows // SPREAD_KEYS + 1)


def join_spread(left: DataFrame, on: list[str], right: DataFrame, keys: list[str], count: str, least: int) -> DataFrame:
    """``left`` joined with a saved table that has each key once and in ``count`` how often ``left`` has it.

    Rows of keys with at least ``least`` rows meet their broadcast partner where they
    are, so no task gets all rows of a key; the others are shuffled as usual.
    """
    same = [F.col(a) == F.col(b) for a, b in zip(on, keys, strict=True)]
    often, rest = right.where(F.col(count) >= least), right.where(F.col(count) < least)
    return left.join(F.broadcast(often), same).unionByName(left.join(F.broadcast(often.select(*keys)), same, "left_anti").join(rest, same))


def strings(array: pa.Array) -> pa.Array:
    """A text column with nulls as empty strings, safe beyond 2 GiB."""
    return pc.fill_null(array.cast(pa.large_string()), "")


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h
