import math
import random
import re

import pytest

from nimbostrat.llm.quality_rules import LEVELS, certified_cutoffs, features, log_tail, quality_rules

LABELS = "doc_id bigint, quality int, toxic int"


def plain(text):
    """The counts of a text, window by window."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = {}, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen[line] = 1
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeated = {x for x in windows if windows.count(x) > 1}
    covered = {i + k for i, x in enumerate(windows) if x in repeated for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


TEXTS = [
    None, "", " \t\n", "one", "a b c d", "a b c d e", "a b c d e a b c d e", "x " * 40, "a b c d e f a b c d e g b c d e f", "l\nl\n\n\nl \nm\nl", "# ## a|b <c> &amp;\r\nz\vq", "über ßtraße 😀 x y z 😀\n😀\n😀",
    "A B C D E\n" * 3 + "tail",
]


def test_counts(spark, docs, by_id):
    rng = random.Random(5)
    texts = TEXTS + [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(150)]
    got = by_id(features(docs([(i, t) for i, t in enumerate(texts)])))
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain(t), t


def test_very_long_text(docs, by_id):
    words = [f"w{i}" for i in range(60_000)]
    got = by_id(features(docs([(1, " ".join(words + words[100:105])), (2, "a b " * 50_000)])))
    assert got[1]["n_repeat_words"] == 10 and got[1]["n_words"] == 60_005
    assert got[2]["n_repeat_words"] == got[2]["n_words"] == 100_000


@pytest.mark.parametrize(("n", "k"), [(10, 0), (100, 0), (400, 3), (5000, 80), (5000, 100), (40_000, 700)])
def test_binomial_tail(spark, n, k):
    exact = sum(math.comb(n, i) * 2**i * 98 ** (n - i) for i in range(k + 1))
    logged = math.log(exact) - n * math.log(100)
    from pyspark.sql import functions as F

    got = spark.range(1).select(log_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), 0.02)).first()[0]
    assert got == pytest.approx(logged, rel=1e-9, abs=1e-9)


def test_cutoffs_keep_the_risk(spark):
    """Against a plain search over all levels, with strata that can and can't be certified."""
    rng, rows = random.Random(3), []
    for stratum, n, noise in (("a", 900, 0.0), ("b", 2500, 0.012), ("c", 60, 0.0), (None, 700, 0.004), ("d", 800, 0.5)):
        rows += [(stratum, rng.uniform(0, 0.9) if rng.random() >= noise else rng.uniform(1, 9), True) for _ in range(n)]
        rows += [(stratum, rng.uniform(0.5, 6), False) for _ in range(n // 5)]
    got = {r["s"]: r for r in certified_cutoffs(spark.createDataFrame(rows, "s string, score double, good boolean"), "s", "good").collect()}
    want = {}
    for stratum in {r[0] for r in rows}:
        good, bad = ([x for s, x, g in rows if s == stratum and g == kind] for kind in (True, False))
        sure = []
        for level in LEVELS:
            lost = sum(x > level for x in good)
            p = sum(math.exp(math.lgamma(len(good) + 1) - math.lgamma(i + 1) - math.lgamma(len(good) - i + 1) + i * math.log(0.02) + (len(good) - i) * math.log(0.98)) for i in range(lost + 1))
            if p <= 0.05 / 5:
                sure.append((sum(x > level for x in bad) * len(good) - lost * len(bad), level))
        if sure:
            want[stratum] = max(sure)[1]
    assert {s: r["cutoff"] for s, r in got.items()} == want
    assert "c" not in got and "d" not in got and {"a", "b", None} <= set(got)
    assert all(r["good_lost"] <= 0.02 * r["n_good"] for r in got.values())


def _corpus():
    rng = random.Random(1)
    prose = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40))
    junk = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) + "***" for _ in range(40))
    rows = [(i, junk() if i % 6 == 0 else prose(), "en", "s") for i in range(900)]
    return rows, [(i, int(i % 6 != 0), 0) for i in range(900)]


def test_verdicts(spark, docs, by_id):
    rows, labels = _corpus()
    more = [(1000, None, "en"), (1001, "too short", "en"), (1002, rows[0][1], "xx"), (1003, rows[0][1], None), (1003, rows[0][1], None), (1004, "a b c d e f " * 9, "en")]
    given = docs(rows + more).withColumnsRenamed({"n_chars": "score"})
    got = by_id(quality_rules(given, spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (1, 1, 1)], LABELS)))
    assert all(got[i]["kept"] == (i % 6 != 0) for i in range(900))
    assert got[1000]["base_failed"] and got[1001]["base_failed"] and got[1004]["base_failed"] and not got[1004]["kept"]
    assert got[1002]["kept"] and got[1002]["cutoff"] is None and got[1003]["kept"]


def test_without_labels_or_rows(spark, docs, by_id):
    rows, _ = _corpus()
    none = spark.createDataFrame([], LABELS)
    assert all(r["kept"] and r["cutoff"] is None for r in by_id(quality_rules(docs(rows[:30]), none)).values())
    assert quality_rules(docs([]), none).count() == 0


def test_native_plan(spark, docs, capsys):
    quality_rules(docs(_corpus()[0][:20]), spark.createDataFrame([(1, 1, 0)], LABELS)).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)
