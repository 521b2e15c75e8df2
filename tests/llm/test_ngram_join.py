import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from nimbostrat.llm import common
from nimbostrat.llm import ngram_join as ngram
from nimbostrat.llm.ngram_join import Points, RTree, Threshold, components, linked, ngram_join, packed, point, shared_keys

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def brute(rows, width, percent):
    """Component of each row by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), d), d)
    return {d: (len(sets[k]), least[find(k)]) for k, (d, _) in enumerate(rows)}


def corpus(seed):
    """Unrelated texts, exact copies, near copies and a passage that many share."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        if rng.random() < 0.4:
            words[len(words) // 2 : len(words) // 2] = passage
        texts.append(words)
        for _ in range(rng.choice([0, 0, 1, 4])):
            near = list(words)
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(near)
    texts += [[], ["one"], ["One"], ["one", "two"], ["one", "two", "three"]]
    rng.shuffle(texts)
    return [(k * 3 + 1, " ".join(w) if w else None) for k, w in enumerate(texts)]


@pytest.mark.parametrize(("width", "percent", "cluster"), [(3, 90, 4096), (5, 80, 4096), (3, 70, 8)])
def test_components_match_all_pairs(docs, by_id, width, percent, cluster):
    rows = corpus(width * percent)
    out = by_id(ngram_join(docs(rows), width=width, percent=percent, cluster=cluster))
    assert {k: (v["n_shingles"], v["component_id"]) for k, v in out.items()} == brute(rows, width, percent)


def test_blocks_bounded_by_shingles(docs, by_id, monkeypatch):
    monkeypatch.setattr("nimbostrat.llm.ngram_join.LOAD", 40)
    width, percent, cluster = 3, 70, 64
    rows = corpus(width * percent)
    out = by_id(ngram_join(docs(rows), width=width, percent=percent, cluster=cluster))
    assert {k: (v["n_shingles"], v["component_id"]) for k, v in out.items()} == brute(rows, width, percent)


def test_odd_tables(docs):
    assert ngram_join(docs([])).count() == 0
    rows = [(5, "a b c d"), (5, "a b c d"), (3, "A B C D"), (None, "a b c d"), (9, None), (8, ""), (7, " \t")]
    out = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join(docs(rows)).collect())
    assert out == [(0, 2, 3), (3, 2, 3), (5, 2, 3), (5, 2, 3), (7, 0, 7), (8, 0, 8), (9, 0, 9)]


def test_tree_finds_every_close_point():
    rng, limits = np.random.default_rng(3), Threshold(80)
    base = [rng.integers(0, 2**63, rng.integers(5, 400)).astype(np.uint64) for _ in range(300)]
    sets = [np.unique(s) for s in base] + [np.unique(s[: max(1, int(len(s) * 0.9))]) for s in base]
    sizes, points = np.array([len(s) for s in sets]), np.array([point(s) for s in sets])
    tree, open_ = RTree(sizes, points), np.ones(len(sets), bool)
    assert len(tree.levels) == 3 and len(tree.levels[-1][1]) == 1
    for k in range(0, len(sets), 17):
        overlap = np.minimum(points, points[k]).sum(axis=1, dtype=np.int64)
        assert sorted(tree.near(k, limits, open_).tolist()) == np.flatnonzero(limits.close(overlap, sizes, sizes[k])).tolist()
    root = linked(sets, limits)
    for k in range(300):
        real = limits.links(len(np.intersect1d(sets[k], sets[300 + k])), sizes[k], sizes[300 + k])
        assert (root[k] == root[300 + k]) == real


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a bigint, b bigint")
    out = {r["v"]: r["root"] for r in components(edges).collect()}
    assert out == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


@pytest.mark.parametrize("run", [2, 4, 30])
def test_keys_dealt_in_parts_hold_every_possible_link(docs, by_id, monkeypatch, run):
    rows = corpus(77)
    monkeypatch.setattr("nimbostrat.llm.ngram_join.RUN", run)
    assert by_id(ngram_join(docs(rows), percent=80)) == {k: {"doc_id": k, "n_shingles": n, "component_id": c} for k, (n, c) in brute(rows, 3, 80).items()}


def test_points_of_any_size():
    rng = np.random.default_rng(1)
    rows = [rng.integers(0, high, groups).astype(np.uint32) for high, groups in ((3, 16), (70_000, 64), (300, 64), (9, 64), (5, 16))]
    points = Points(pa.array([packed(r) for r in rows], pa.binary()))
    a, b = (np.array(x) for x in zip(*combinations(range(len(rows)), 2), strict=True))
    fold = lambda r: r.reshape(-1, 16).sum(axis=0)
    want = [np.minimum(x, y).sum() if len(x) == len(y) else np.minimum(fold(x), fold(y)).sum() for x, y in ((rows[i], rows[j]) for i, j in zip(a, b, strict=True))]
    assert points.overlap(a, b).tolist() == want


def test_very_long_text_and_other_columns(spark, by_id):
    """Clashing names are ignored, and a text of 300,000 words links with its copy."""
    words = [f"w{k * k % 99991}" for k in range(300_000)]
    rows = [(1, " ".join(words), 5, "x"), (2, " ".join([*words[:-50], "end"]), 6, "y"), (3, "w1 w4 w9 w16", 7, "z")]
    out = by_id(ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string, rid int, component_id string")))
    assert [out[k]["component_id"] for k in (1, 2, 3)] == [1, 1, 3] and set(out[1]) == {"doc_id", "n_shingles", "component_id"}


def test_a_key_beyond_the_inner_ones_needs_a_smaller_set(spark):
    rows = [(1, 100, 1, False), (1, 100, 2, False), (2, 100, 3, True), (2, 104, 4, False), (3, 100, 5, False), (3, 104, 6, True), (4, 50, 7, True), (4, 100, 8, True), (5, 100, 9, True), (5, 101, 10, False), (5, 102, 11, False)]
    entries = spark.createDataFrame(rows, "key bigint, n int, rid bigint, inner boolean")
    got = {r["rid"] for r in shared_keys(entries, Threshold(90)).collect()}
    assert got == {3, 4, 9, 10, 11}


@pytest.mark.parametrize(("percent", "n"), [(90, 100), (90, 395), (90, 700), (80, 60), (80, 156), (80, 700)])
def test_unrelated_points_are_far(percent, n):
    """A share of all pairs within the bound would connect most texts of a large table."""
    rng, limits = np.random.default_rng(2), Threshold(percent)
    points = np.array([point(rng.integers(0, 1 << 63, n, dtype=np.uint64), limits.groups(n)) for _ in range(400)])
    overlap = np.minimum(points[:200, None], points[None, 200:]).sum(axis=2, dtype=np.int64)
    assert not limits.close(overlap, n, n).any()


def test_points_of_small_counts_take_half_a_byte():
    rng = np.random.default_rng(3)
    rows = [rng.integers(0, high, 64).astype(np.uint32) for high in (16, 16, 17, 3)]
    rows[0][0], rows[2][0] = 15, 16
    assert [len(packed(r)) for r in rows] == [33, 33, 65, 33]
    points = Points(pa.array([packed(r) for r in rows], pa.binary()))
    a, b = map(np.array, zip(*combinations(range(4), 2), strict=True))
    assert points.overlap(a, b).tolist() == [int(np.minimum(rows[x], rows[y]).sum()) for x, y in zip(a, b, strict=True)]


def test_a_text_of_a_loose_cluster_meets_a_bounded_number_of_blocks(docs, by_id, monkeypatch):
    """Edits of one text, many of them not linked: the cluster is dealt in pairs of blocks."""
    rng, base, sent = random.Random(8), [f"w{k}" for k in range(40)], []
    rows = [(k, " ".join(w if rng.random() > 0.05 else f"e{rng.random()}" for w in base)) for k in range(160)]
    verify = ngram._verify

    def counted(groups, *rest):
        sent.append(groups.groupBy("rid").count().agg({"count": "max"}).first()[0] or 0)
        return verify(groups, *rest)

    monkeypatch.setattr(ngram, "_verify", counted)
    monkeypatch.setattr(Threshold, "close", lambda self, overlap, n, m: overlap == overlap)
    out = by_id(ngram_join(docs(rows), width=1, percent=90, cluster=4))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in out.items()} == brute(rows, 1, 90)
    assert 1 < max(sent) <= ngram.BLOCKS + ngram.LONGER + 4


@pytest.mark.parametrize("most", [0, 3, 100])
def test_few_rows_meet_ids_beyond_reach(spark, most, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(common, "BROADCAST_HASHES", most)
    rows = spark.createDataFrame([(k, k % 50) for k in range(200)], "k long, h long")
    ids = common.saved(spark.createDataFrame([(h,) for h in (3, 3, 4, 99)], "hash long"))
    far, near = common.by_hash(rows, rows["h"], ids, "hash")
    if most < 3:
        assert far is None and near is rows
        return
    assert {r["h"] for r in near.collect()} == {3, 4}
    assert sorted(r["k"] for r in far.unionByName(near).collect()) == list(range(200))
    assert "BroadcastHashJoin" in far._jdf.queryExecution().executedPlan().toString()
    assert common.by_hash(rows, rows["h"], common.saved(ids.limit(2)), "hash") == (None, rows)


@pytest.mark.parametrize("rows", [0, 2])
def test_joins_beyond_reach_give_the_same(docs, by_id, monkeypatch, rows):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    given = corpus(3)
    out = by_id(ngram_join(docs(given), width=2, percent=80, cluster=8))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in out.items()} == brute(given, 2, 80)
