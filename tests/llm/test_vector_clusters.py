import hashlib
import math
import random

from nimbostrat.llm import common
from nimbostrat.llm.vector_clusters import cluster_vectors

SCHEMA = "label int, vec_id bigint, embedding array<double>, q string"


def plain(rows, k, rounds, dims):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, vs in groups.items():
            centroids[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    own = {n: sum(d for _, d, m in found if m == n) for _, _, n in found}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, own[n], sum(own.values()), digest[n]) for i, d, n in found), key=repr)


def result(spark, rows, **kw):
    df = cluster_vectors(spark.createDataFrame([(1, i, v, "x") for i, v in rows], SCHEMA), **kw)
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _rows(seed=1, n=400, dims=6):
    rng = random.Random(seed)
    hot = [0.5] * dims
    rows = [(i, hot if i % 3 == 0 else [rng.choice((-1, 1)) * rng.choice((0.0, 0.01, 0.3, 1.2)) for _ in range(dims)]) for i in range(n)]
    bad = [(900, None), (901, [0.1] * (dims - 1)), (902, [0.1] * (dims + 1)), (903, [None] + [0.1] * (dims - 1)), (904, [math.nan] * dims), (905, [math.inf] * dims), (906, [-math.inf] * dims), (907, [])]
    return rows + bad + [(None, hot), (None, rows[1][1]), (7, rows[7][1])]


def test_against_plain_rounds(spark, monkeypatch):
    want = plain(_rows(), 5, 3, 6)
    assert result(spark, _rows(), k=5, dims=6) == want
    monkeypatch.setattr(common, "SPREAD_ROWS", 5)  # the hot vector is spread
    assert result(spark, _rows(), k=5, dims=6) == want


def test_few_and_no_vectors(spark):
    rows = [(1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, [9.0, -9.0])]
    assert result(spark, rows, k=16, dims=2) == plain(rows, 16, 3, 2)
    assert result(spark, [], dims=2) == [] and result(spark, [(1, None), (2, [])], dims=2) == []


def test_no_round_and_ties(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(20)] + [(99, [0.5, 0.0])]
    assert result(spark, rows, k=3, rounds=0, dims=2) == plain(rows, 3, 0, 2)


def test_huge_components(spark):
    got = result(spark, [(1, [1e300, -1e300]), (2, [-1e300, 1e300]), (3, [1.7e308, 0.0])], k=1, rounds=0, dims=2)
    assert len(got) == 3 and all(0 <= r[2] < 1 << 63 for r in got)
