"""Interval plans: totals, windows and liquid chunks."""

import random

import pytest

from nimbostrat.operators.intervals import Plans, liquid_chunks, resume_steps, source_hours, window_terms

INTERVALS = "model string, start_hour bigint, end_hour bigint"


def test_a_total_is_chained_from_what_ends_at_each_hour():
    book = Plans([(0, 3), (3, 4), (0, 1)], {0, 1, 3, 4})
    assert book.total(4) == [(0, 3), (3, 4)]
    # the last three hours: the chained total less the first hour
    assert book.window(4, 3) == {(0, 3): 1.0, (3, 4): 1.0, (0, 1): -1.0}
    assert book.window(3, None) == {(0, 3): 1.0} and book.window(0, 3) == {}


def test_windows_without_totals_are_tiled():
    book = Plans([(6, 9), (9, 12), (9, 10), (12, 15)], {9, 10, 12, 15})
    assert book.window(15, 9) == {(6, 9): 1.0, (9, 12): 1.0, (12, 15): 1.0}
    assert book.window(15, 8) == {} and book.total(15) == []


def test_unpublished_hours_give_no_plan():
    assert Plans([(0, 3), (3, 6)], {6}).window(6, None) == {}


def total_by_search(spans, hours, h):
    """The total's rule, written as plain recursion."""
    if h <= 0 or h not in hours:
        return []
    if (0, h) in spans:
        return [(0, h)]
    starts = sorted(a for a, b in spans if b == h)
    if starts:
        before = total_by_search(spans, hours, starts[0])
        if before or starts[0] == 0:
            return [*before, (starts[0], h)]
    return tiles_by_search(spans, 0, h)


def tiles_by_search(spans, a, b):
    out = []
    while a < b:
        ends = [y for x, y in spans if x == a and y <= b]
        if not ends:
            return []
        out.append((a, max(ends)))
        a = max(ends)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_plans_match_plain_recursion(seed):
    rng = random.Random(seed)
    hours = set(rng.sample(range(13), 10))
    spans = {(a, a + rng.randint(1, 4)) for a in rng.choices(range(12), k=12)}
    usable = {s for s in spans if s[1] in hours}
    book = Plans(list(spans), hours)
    for h in hours:
        assert book.total(h) == total_by_search(usable, hours, h)
        for length in (2, 5):
            start = max(0, h - length)
            got, whole, before = book.window(h, length), total_by_search(usable, hours, h), total_by_search(usable, hours, start)
            if h and (start, h) in usable:
                assert got == {(start, h): 1.0}
            elif h and whole and (start == 0 or before):
                weights = {t: whole.count(t) - before.count(t) for t in {*whole, *before}}
                assert got == {t: w for t, w in weights.items() if w}
            else:
                assert list(got) == (tiles_by_search(usable, start, h) if h else [])


def test_terms_by_model(spark):
    rows = spark.createDataFrame([("a", 0, 3), ("a", 3, 4), ("b", 0, 4), ("b", 1, 1)], INTERVALS)
    hours = spark.createDataFrame([("a", 3), ("a", 4), ("b", 4), ("c", 4)], "model string, hour bigint")
    got = sorted(map(tuple, window_terms(rows, None, hours).collect()))
    assert got == [("a", 3, 0, 3, 1.0), ("a", 4, 0, 3, 1.0), ("a", 4, 3, 4, 1.0), ("b", 4, 0, 4, 1.0)]
    assert window_terms(rows.limit(0), 6, hours.limit(0)).count() == 0


def test_chunks_prefer_differences_then_records_then_masks(spark):
    """Totals at 3 and 6, a direct hour after them, and masked precipitation for the rest."""
    rows = [("m", "direct", 0, 3), ("m", "direct", 0, 6), ("m", "direct", 6, 7), ("m", "masked", 6, 7), ("m", "masked", 7, 9), ("m", "masked", 3, 6)]
    table = spark.createDataFrame(rows, "model string, kind string, start_hour bigint, end_hour bigint")
    got = [(r["kind"], r["start_hour"], r["end_hour"], [(t["kind"], t["start_hour"], t["end_hour"], t["weight"]) for t in r["terms"]]) for r in liquid_chunks(table, 0, 9).orderBy("step").collect()]
    assert got == [
        ("delta", 0, 3, [("direct", 0, 3, 1.0)]),
        ("delta", 3, 6, [("direct", 0, 6, 1.0), ("direct", 0, 3, -1.0)]),
        ("direct", 6, 7, [("direct", 6, 7, 1.0)]),
        ("masked", 7, 9, [("masked", 7, 9, 1.0)]),
    ]
    # from 3 on: the total at 3 allows a difference; from 4 on there is no path
    assert [r["kind"] for r in liquid_chunks(table, 3, 7).orderBy("step").collect()] == ["delta", "direct"]
    assert liquid_chunks(table, 4, 9).count() == 0


def test_resume_steps_and_source_hours(spark):
    rows = spark.createDataFrame([("a", 0, 3), ("a", 3, 6), ("a", 0, 6), ("a", 8, 9)], INTERVALS)
    assert sorted(map(tuple, resume_steps(rows, 24).collect())) == [("a", 3, 0), ("a", 6, 3)]
    held, targets = spark.createDataFrame([("g", 7)], "model string, hour bigint"), spark.createDataFrame([("g", 11), ("h", 0)], "model string, target bigint")
    got = sorted(map(tuple, source_hours(held, targets, 4, 3).collect()))
    assert got == [("g", x) for x in (0, 1, 2, 3, 4, 7, 10, 11)] + [("h", 0)]


def test_runs_of_one_model_have_plans_of_their_own(spark):
    """The same hours with other intervals in another run; by model alone they would mix."""
    spans = [("m", 1, 0, 3), ("m", 1, 3, 6), ("m", 2, 0, 6), ("m", 2, 6, 9)]
    hours = [("m", r, h) for r in (1, 2) for h in (3, 6, 9)]
    found = window_terms(spark.createDataFrame(spans, "model string, run int, start_hour int, end_hour int"), 6, spark.createDataFrame(hours, "model string, run int, hour int"), ("model", "run"))
    got = {(r["run"], r["hour"], r["start_hour"], r["end_hour"]): r["weight"] for r in found.collect()}
    assert {k[:2] for k in got if k[1] == 9} == set() and {k for k in got if k[1] == 6} == {(1, 6, 0, 3), (1, 6, 3, 6), (2, 6, 0, 6)}
