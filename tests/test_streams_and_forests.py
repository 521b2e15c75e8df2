"""Streamed sums against the window over a run, forests against plain walks, closure of record selection."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nimbostrat.operators import accumulate, forest, selection
from nimbostrat.sources import inventory
from nimbostrat.streaming import sums


def whole(amounts, first, step):
    """Sums hour by hour; unknown from the first missing amount on."""
    out, total = [], 0.0
    for k, a in enumerate(amounts):
        total = None if total is None or a is None else total + a
        out.append((first + k * step, total))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 50).map(float)), max_size=30), st.integers(0, 5), st.integers(1, 6), st.randoms(use_true_random=False))
def test_any_order_cut_and_repetition(amounts, first, step, rng):
    rows = [(first + k * step, a) for k, a in enumerate(amounts)]
    rows += rng.sample(rows, len(rows) // 3)
    rng.shuffle(rows)
    state, got = (first, 0.0, True, [], []), []
    while rows:
        n = rng.randrange(1, len(rows) + 1)
        state, settled = sums.fold(state, rows[:n], step)
        got, rows = got + settled, rows[n:]
    assert got == whole(amounts, first, step) and not state[3]


def test_waits_for_an_hour_that_has_not_come():
    state, settled = sums.fold((3, 0.0, True, [], []), [(9, 1.0), (3, 2.0), (12, 4.0)], 3)
    assert settled == [(3, 2.0)] and state[3] == [9, 12]
    state, settled = sums.fold(state, [(6, None)], 3)
    assert settled == [(6, None), (9, None), (12, None)] and state[:3] == (15, 2.0, False)


SCHEMA = "cell long, hour long, value double"


def test_stream_equals_the_batch_and_goes_on_after_a_restart(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, h, None if rng.random() < 0.06 else round(rng.uniform(0, 5), 2)) for c in range(12) for h in range(1, 15)]
    want = {(r["cell"], r["hour"]): r["total"] for r in accumulate.cumulative(spark.createDataFrame(rows, SCHEMA), ("cell",)).collect()}
    mixed = rows + rng.sample(rows, 30)
    rng.shuffle(mixed)
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    cuts = [mixed[:60], mixed[60:61], mixed[61:150], mixed[150:]]
    for k, part in enumerate(cuts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if k in (1, 3):  # two runs, the second from the first one's checkpoint
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            sums.run_to_table(sums.cumulative_sums(stream), out, state)
    got = [(r["cell"], r["hour"], r["total"]) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(want)
    for c, h, t in got:
        assert t == pytest.approx(want[c, h]) if want[c, h] is not None else t is None


def test_resume_point(spark, tmp_path):
    """Sums go on from an earlier run's; a broken one stays unknown; a new cell starts at the first hour."""
    resume = spark.createDataFrame([(1, 4, 10.0), (2, 4, None)], "cell long, hour long, total double")
    rows = [(1, 3, 99.0), (1, 6, 1.0), (1, 5, 2.0), (2, 5, 7.0), (3, 2, 4.0), (3, 1, 1.5), (3, None, 8.0)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    sums.run_to_table(sums.cumulative_sums(stream, resume=resume), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r["cell"], r["hour"]): r["total"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 5): 12.0, (1, 6): 13.0, (2, 5): None, (3, 1): 1.5, (3, 2): 5.5}


def grown(trees, depth, features, seed):
    """Rows of random trees: nodes numbered from 1 in heap order, some subtrees cut off."""
    rng = np.random.default_rng(seed)
    rows = []
    for tree in range(trees):
        alive = {1}
        for node in range(1, 1 << (depth + 1)):
            if node not in alive:
                continue
            inner = node < 1 << depth and (node < 8 or rng.random() < 0.8)
            if inner:
                alive |= {2 * node, 2 * node + 1}
            rows.append((tree, node, 2 * node if inner else None, 2 * node + 1 if inner else None, int(rng.integers(features)), float(rng.normal()), float(rng.normal())))
    return pd.DataFrame(rows, columns=["tree", "node", "left", "right", "feature", "threshold", "value"])


def walked(nodes, x):
    """The mean of the trees' leaves, node by node; a missing feature casts no vote."""
    votes = []
    for root, by_node in nodes:
        node = by_node[root]
        while node[1] >= 0 and np.isfinite(x[node[3]]):
            node = by_node[node[1] if x[node[3]] <= node[4] else node[2]]
        if node[1] < 0:
            votes.append(node[5])
    return sum(votes) / len(votes) if votes else None


def test_a_large_forest_equals_plain_walks(spark, tmp_path):
    table = grown(300, 12, 24, 1)
    assert len(table) > 300_000
    table.astype({"left": "Int64", "right": "Int64"}).to_parquet(tmp_path / "nodes.parquet")
    found = forest.forest_from_table(spark.read.parquet(str(tmp_path / "nodes.parquet")))
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 24))
    x[5] = np.nan
    x[6, :12] = np.nan
    rows = table[["node", "left", "right", "feature", "threshold", "value"]].fillna(-1)
    plain = [(1, {int(n): (int(n), int(a), int(b), int(f), t, v) for n, a, b, f, t, v in rows[table["tree"] == k].itertuples(index=False)}) for k in range(300)]
    got = found.predict(x)
    for k in range(40):
        want = walked(plain, x[k])
        assert got[k] == pytest.approx(want) if want is not None else np.isnan(got[k])


def test_forest_over_rows_and_edges(spark):
    nodes = spark.createDataFrame([(7, 0, 1, 2, 0, 1.0, 0.0), (7, 1, -1, -1, 0, 0.0, 5.0), (7, 2, 9, 9, 0, 0.0, 8.0), (8, 4, None, None, None, None, 2.0)], "tree int, node int, left int, right int, feature int, threshold double, value double")
    model = forest.forest_from_table(nodes)
    cells = spark.createDataFrame([(1, [0.5]), (2, [2.0]), (3, None), (4, [None])], "cell int, features array<double>")
    got = {r["cell"]: r["ratio"] for r in forest.forest_values(cells, model).collect()}
    assert got == {1: 3.5, 2: 5.0, 3: None, 4: 2.0}  # a child that isn't there makes a leaf; the single-leaf tree always votes


def test_trees_that_are_alike_are_kept_once(spark, monkeypatch):
    shape = "CASE WHEN id % 3 = 0 THEN 1 END left, CASE WHEN id % 3 = 0 THEN 2 END right, 0 feature, CASE WHEN id < 3000 THEN 1.0D ELSE 3.0D END threshold, CAST(id % 3 * 4 AS double) value"
    nodes = spark.range(6000).selectExpr("id div 3 tree", "id % 3 node", *shape.split(", "))[["tree", "node", "left", "right", "feature", "threshold", "value"]]
    monkeypatch.setattr(forest, "MOST_NODES", 6)
    model = forest.forest_from_table(nodes)
    assert len(model.roots) == 2 and model.weights.tolist() == [1000.0, 1000.0]
    monkeypatch.setattr(forest, "WALKS", 1024)  # one tree a block
    assert model.predict(np.array([[0.5], [2.0], [4.0], [np.nan]])).tolist()[:3] == [4.0, 6.0, 8.0]


def test_forest_of_too_many_nodes_is_refused(spark, monkeypatch):
    monkeypatch.setattr(forest, "MOST_NODES", 3)
    with pytest.raises(ValueError):
        forest.forest_from_table(spark.range(4).selectExpr("id tree", "id node", "-1 left", "-1 right", "0 feature", "0.0 threshold", "1.0 value"))


# A file as forecast centres write it: record, offset, parameter, level, what it covers.
FILE = [
    "1:0:d=2026042512:PRMSL:mean sea level:anl:", "3:200:d=2026042512:REFC:entire atmosphere (considered as a single layer):anl:", "71:300:d=2026042512:HGT:500 mb:anl:", "72.1:320:d=2026042512:UGRD:500 mb:anl:", "72.2:320:d=2026042512:VGRD:500 mb:anl:",
    "120:400:d=2026042512:APCP:surface:0-3 hour acc fcst:", "121:500:d=2026042512:APCP:surface:2-3 hour acc fcst:", "330:600:d=2026042512:CSNOW:surface:3 hour fcst:", "333:700:d=2026042512:CRAIN:surface:3 hour fcst:",
    "334:800:d=2026042512:CFRZR:surface:3 hour fcst:", "335:900:d=2026042512:CICEP:surface:3 hour fcst:", "336:1000:d=2026042512:TMP:2 m above ground:anl:", "400:1100:d=2026042512:TMP:2 m above ground:anl:", "401:1200:d=2026042512:HGT:surface:anl:",
]
AVERAGES = [f"{500 + k}:{2000 + 100 * k}:d=2026042512:{p}:surface:0-3 hour ave fcst:" for k, p in enumerate(("CSNOW", "CRAIN", "CFRZR", "CICEP"))]


def chosen(spark, lines, wanted, hour=3):
    table = spark.createDataFrame([(hour, k, x) for k, x in enumerate(lines)], "hour int, ordinal int, line string")
    return {r["record"]: r for r in selection.selected_records(inventory.parse_lines(table), spark, "hrrr", wanted).collect()}


def test_selection_of_plain_products(spark):
    got = chosen(spark, FILE, ["reflectivityComposite", "temperature", "wind500", "height500"])
    assert set(got) == {"3", "336", "71", "72.1", "72.2"}  # the first of two temperatures, the layer by its pattern
    assert (got["72.1"]["first_byte"], got["72.1"]["last_byte"]) == (got["72.2"]["first_byte"], got["72.2"]["last_byte"]) == (320, 399)
    assert got["71"]["wanted_by"] == ["height500"] and got["72.1"]["wanted_by"] == ["wind500"]
    assert not chosen(spark, FILE, [])


def test_selection_follows_the_liquid(spark):
    now = {"120", "330", "333", "334", "335"}
    assert set(chosen(spark, FILE, ["snow10to1"])) == now
    # averages over the longest window take the place of the phases at its end
    assert set(chosen(spark, FILE + AVERAGES, ["snow10to1"])) == {"120", "500", "501", "502", "503"}
    # an own accumulation takes the place of both
    assert set(chosen(spark, FILE + ["600:9000:d=2026042512:WEASD:surface:1-3 hour acc fcst:"], ["snow10to1"])) == {"600"}
    # a profile needs the height of the ground, and comes with each product that asks for it
    kuchera = chosen(spark, FILE, ["snowKuchera", "temperature"])
    assert set(kuchera) == now | {"401", "336", "71"} and kuchera["401"]["wanted_by"] == ["snowKuchera"] and kuchera["120"]["wanted_by"] == ["liquid"]
    assert not chosen(spark, FILE, ["snow10to1", "snowKuchera"], hour=0)
    assert not chosen(spark, FILE[:9], ["snow10to1"])  # two phases are unknown
