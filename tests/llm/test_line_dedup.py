import random
from collections import Counter

import pytest

from nimbostrat.llm import common, line_dedup
from nimbostrat.llm.line_dedup import drop_recurring_lines


def test_recurring_templates_go_everywhere(docs, by_id):
    rows = [(k, f"Own line number {'abcdefghijklmnopqrstuvwxyz'[k]} stays put\nLicensed under version {k}.0 of it\nUser {'abcdefghij'[k % 10]} joined the open channel today ok") for k in range(20)]
    out = by_id(drop_recurring_lines(docs(rows), min_docs=10, similarity=0.99))
    assert all(v["n_lines"] == 3 and "Licensed" not in v["text"] for v in out.values())
    loose = by_id(drop_recurring_lines(docs(rows), min_docs=10, depth=1))
    assert all("joined" not in v["text"] for v in loose.values())
    none = by_id(drop_recurring_lines(docs(rows), min_docs=21))
    assert all(none[k]["text"] == t and none[k]["n_dropped"] == 0 for k, t in rows)


def test_one_document_repeating_a_line_is_not_recurring(docs, by_id):
    out = by_id(drop_recurring_lines(docs([(1, "same line here\n" * 30), (2, None), (3, "")]), min_docs=2))
    assert out[1]["text"] == "same line here\n" * 30 and out[2]["text"] == "" and out[2]["n_lines"] == 1 and out[3]["n_dropped"] == 0


def test_odd_tables(docs):
    assert drop_recurring_lines(docs([])).count() == 0
    twice = drop_recurring_lines(docs([(1, "a b"), (1, "a b"), (2, "a b"), (None, "a b\n\nx")]), min_docs=3).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in twice) == [(0, "\nx"), (1, ""), (1, ""), (2, "")]


def words_of(line):
    return tuple("<*>" if any(c.isdigit() for c in w) else w for w in line.split())


def brute(rows, min_docs, depth, similarity):
    """Ranks and templates of every line, written out."""
    counts, holders = Counter(), {}
    for _, text in rows:
        for line in (text or "").split("\n"):
            w = words_of(line)
            counts.update((len(w), w[:depth], k, x) for k, x in enumerate(w))

    def templates(line):
        w = words_of(line)
        ranked = sorted((counts[len(w), w[:depth], k, x], k) for k, x in enumerate(w))
        most = int((1 - similarity) * len(w) + 1e-9)
        ends = [0] + [k for k in range(1, most + 1) if k < len(w) and ranked[k - 1][0] < ranked[k][0]]
        return {tuple(None if k in {p for _, p in ranked[:e]} else x for k, x in enumerate(w)) for e in ends} if w else set()

    for row in set(rows):
        for line in (row[1] or "").split("\n"):
            for t in templates(line):
                holders.setdefault(t, set()).add((row[0], row[1] or ""))
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not any(len(holders[t]) >= min_docs for t in templates(x))]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("frequent", [2, 1000])
@pytest.mark.parametrize(("depth", "similarity"), [(3, 0.7), (1, 0.5)])
def test_whole_operator_matches_brute_force(docs, depth, similarity, frequent, monkeypatch):
    """Also with words and templates spread from two rows on, and with leaves joined instead of known."""
    monkeypatch.setattr(common, "SPREAD_ROWS", frequent)
    monkeypatch.setattr(line_dedup, "KNOWN_LEAVES", frequent)
    rng = random.Random(depth)
    line = lambda: " ".join(rng.choice(["a b c", "d e f", "a"]).split() + rng.choices("xyz12", k=rng.randint(0, 9)))
    rows = [(k % 55, rng.choice(["\n", "", "\n\n "]).join(line() for _ in range(rng.randint(0, 6)))) for k in range(60)]
    rows += [rows[3], (None, rows[4][1]), (None, None), (99, "Ünï\u00a0code \t tabs\r\nx")]
    got = drop_recurring_lines(docs(rows), min_docs=4, depth=depth, similarity=similarity)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 4, depth, similarity)


FAMILIES = [
    "The user account named {} has logged in from the host called {} today", "This article was posted by {} in the category {}", "Sent to you by {} on behalf of the team at {} and of {} too",
    "Read the story of {} and {} here", "This article was posted by {} in our archive",
]


def test_fields_anywhere_in_a_line(docs, by_id):
    """200 lines of each family, all fields behind the third word, names without digits; prose between them stays."""
    rng = random.Random(2)
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    prose = lambda: " ".join(name() for _ in range(rng.randint(4, 14)))
    own = [[prose(), prose()] for _ in range(200)]
    rows = [(k, "\n".join([own[k][0], *[f.format(name(), name(), name()) for f in FAMILIES], own[k][1]])) for k in range(200)]
    out = by_id(drop_recurring_lines(docs(rows)))
    assert all(out[k]["text"] == "\n".join(own[k]) and out[k]["n_dropped"] == len(FAMILIES) for k in range(200))


def test_frequent_values_of_two_fields(docs, by_id):
    """Each value recurs by itself but hardly any pair does: the line is one template nevertheless."""
    names = ["anna", "bert", "carl", "dora", "emil", "fred", "gina", "hans", "inge", "jens", "kurt", "lena", "mona", "nils"]
    rows = [(k, f"Please write to {names[k % 14]} or ask {names[k // 14]} at the desk downstairs") for k in range(196)]
    assert all(r["text"] == "" and r["n_dropped"] == 1 for r in by_id(drop_recurring_lines(docs(rows))).values())


def test_different_lines_of_one_leaf_stay(docs, by_id):
    """Lines that agree in less than the similarity aren't one template, however full their leaf is."""
    rng = random.Random(6)
    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [(k, "This is the " + " ".join(name() for _ in range(5))) for k in range(120)]
    assert all(r["n_dropped"] == 0 for r in by_id(drop_recurring_lines(docs(rows))).values())


def test_a_hot_leaf_long_text_and_other_columns(spark):
    """Thousands of different lines of one count and opening; a text of 400,000 words; clashing names are ignored."""
    lines = [f"the hot leaf {' '.join(random.Random(k).choices('abcdefghijklmnopqrst', k=7))}" for k in range(6000)]
    rows = [(k, "\n".join(lines[k::40]) + "\nthe hot leaf has one more line that all share", "x", k) for k in range(40)]
    rows.append((100, "word " * 400_000, "y", 0))
    out = {r["doc_id"]: r for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string, template string, n_lines int")).collect()}
    assert out[100]["text"] == rows[-1][1] and out[100]["n_lines"] == 1
    assert all("all share" not in out[k]["text"] and out[k]["n_lines"] == 151 for k in range(40))
