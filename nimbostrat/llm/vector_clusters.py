"""Centroid clustering of deduplicated vectors.

Vectors are quantised to integers and identical ones become one row with their
number.  Lloyd's rounds run on these distinct rows: a task sums its vectors, each
times its number, for each centroid, and only these sums leave it.  At last the
assignments are joined back to the ids.

All arithmetic is on integers, so results don't depend on order or partitions.
Components beyond 2^27 in size count as 2^27 of their sign, so that a squared
distance always fits 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbostrat.llm.common import bound_batches, forget, fresh, join_spread, saved, spread_from

K, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, "1"
MOST = 1 << 27


def quantised(vectors: DataFrame, id_: str, vec: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """id, q: the vectors of exactly ``dims`` finite components, as integers floor(scale * x)."""
    x = F.transform(F.col(f"`{vec}`"), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * float(scale), F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))
    return vectors.where((F.size(F.col(f"`{vec}`")) == dims) & fine).select(F.col(f"`{id_}`").alias("id"), whole.alias("q"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims).astype(np.int64)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller of equals, and its squared distance."""
    d = (q * q).sum(1)[:, None] - 2 * (q @ centroids.T) + (centroids * centroids).sum(1)[None, :]
    best = d.argmin(1)
    return best, d[np.arange(len(q)), best]


def _sums(distinct: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """For each centroid that has vectors: how many, and the sums of their components."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            q, often = _matrix(batch.column(0), dims), batch.column(1).to_numpy()
            best, _ = nearest(q, centroids)
            np.add.at(n, best, often)
            np.add.at(total, best, q * often[:, None])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = distinct.select("q", "n").mapInArrow(run, "cluster int, n bigint, total array<bigint>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dims)]).alias("total")).collect()
    return {r["cluster"]: (r["n"], r["total"]) for r in rows}


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """``centroids`` after some rounds over distinct vectors q with their numbers n; empty ones stay."""
    for _ in range(rounds):
        moved = centroids.copy()
        for cluster, (n, total) in _sums(distinct, centroids).items():
            moved[cluster] = [t // n for t in total]
        centroids = moved
    return centroids


def cluster_vectors(vectors: DataFrame, id_: str = "vec_id", vec: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    vectors: an id and an array of numbers; other columns are ignored. Vectors that are
    null, of another length or with a null or non-finite component are left out. The first
    centroids are the ``k`` vectors with the smallest sha256 of seed:id, null ids last, ties
    by components; with fewer vectors there are fewer. Ties of distance go to the smaller number. Repeated
    rows count as often as they stand there. No vector gives no row.
    """
    bound_batches(vectors.sparkSession)
    spark, rows = vectors.sparkSession, quantised(vectors, id_, vec, dims, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.withColumn("h", order).orderBy(F.col("h").asc_nulls_last(), "q").limit(k).collect()
    centroids = np.array([r["q"] for r in first], np.int64).reshape(-1, dims)
    distinct = saved(rows.groupBy("q").agg(F.count(F.lit(1)).alias("n")))
    centroids = lloyd(distinct, centroids, rounds) if len(first) else np.zeros((1, dims), np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance = nearest(_matrix(batch.column(0), dims), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best.astype(np.int32)), pa.array(distance)], names=["q", "n", "cluster", "distance"])

    assigned = saved(distinct.mapInArrow(assign, "q array<int>, n bigint, cluster int, distance bigint"))
    forget(distinct)
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).alias("s")).collect()}
    final = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    about = spark.createDataFrame(final, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    total = assigned.agg(F.sum("n")).first()[0] or 0
    key = fresh("q")
    out = join_spread(rows, ["q"], assigned.withColumnRenamed("q", key), [key], "n", spread_from(total))
    return out.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
