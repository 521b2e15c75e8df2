import hashlib
import random

import pytest
from pyspark.sql import functions as F

from nimbostrat.llm.mixing import budgets, mix

WEIGHTS = {"domain": {"web": 0.6, "curated": 0.4}, "lang": {"en": 0.5, "de": 0.5}}


def test_shortages_go_to_siblings_before_ancestors(spark):
    rows = [("web", "en", "s1", 10, 1), ("web", "en", "s2", 1000, 1), ("web", "de", "s1", 20, 1), ("curated", "en", "s11", 1000, 1), ("curated", "de", "s12", 1000, 1)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, size bigint, n_docs bigint")
    out = {(r["domain"], r["lang"], r["source"]): r["allocation"] for r in budgets(leaves, WEIGHTS, 1000).collect()}
    # web gets 600: German has 20 and English takes the rest; its s1 has 10 and s2 takes the rest
    assert out == {("web", "en", "s1"): 10, ("web", "en", "s2"): 570, ("web", "de", "s1"): 20, ("curated", "en", "s11"): 200, ("curated", "de", "s12"): 200}
    poor = {r["domain"]: r["a"] for r in budgets(leaves, WEIGHTS, 2900).groupBy("domain").agg(F.sum("allocation").alias("a")).collect()}
    assert poor == {"web": 1030, "curated": 1870}
    none = budgets(leaves, {"domain": {"web": 0.0}}, 500).groupBy("domain").agg(F.sum("allocation").alias("a")).collect()
    assert {r["domain"]: r["a"] for r in none} == {"web": 0, "curated": 500}


def brute(rows, allocation, size, seed):
    """Copies of each document of one leaf."""
    full, rest = divmod(allocation, size)
    order = sorted(rows, key=lambda r: (hashlib.md5(f"{seed}:{full}:{r[0]}".encode()).hexdigest(), r[0]))
    out, used = {}, 0
    for doc_id, n in order:
        used += n
        out[doc_id] = full + (used <= rest)
    return out


@pytest.mark.parametrize(("budget", "epochs"), [(0.5, 1.0), (0.9, 2.0), (1.0, 1.0), (5000.0, 3.0)])
def test_prefixes_match_brute_force(docs, by_id, budget, epochs, monkeypatch):
    monkeypatch.setattr("nimbostrat.llm.mixing.BUCKET_ROWS", 7)
    rng = random.Random(8)
    rows = [(k, "w " * rng.randint(0, 30), rng.choice(["en", "de"]), rng.choice(["s1", "s2", "s12"])) for k in range(300)]
    table = docs(rows)
    out = by_id(mix(table, WEIGHTS, budget, epochs, seed=3))
    tree = table.withColumn("domain", F.when(F.col("source") == "s12", "curated").otherwise("web")).withColumn("tokens", F.size(F.split("text", " ")) - 1)
    leaves = tree.groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("size"), F.count("*").alias("n_docs"))
    for leaf in budgets(leaves, WEIGHTS, budget, epochs=epochs).collect():
        own = [(k, len(t.split())) for k, t, lang, s in rows if (lang, s) == (leaf["lang"], leaf["source"])]
        expected = brute(own, leaf["allocation"], leaf["size"], 3)
        assert {k: out[k]["n_copies"] for k, _ in own} == expected
        assert sum(expected[k] * n for k, n in own) <= leaf["allocation"]


def test_odd_tables(docs):
    assert mix(docs([]), WEIGHTS, 0.5).count() == 0
    rows = [(1, None, None, None), (2, "a b", "en", None), (2, "a b", "en", None), (None, "c d e", "xx", "s5"), (4, "", "de", "s3")]
    out = mix(docs(rows).withColumnRenamed("n_chars", "n_copies"), {}, 1.0).collect()
    assert len(out) == 5 and all(r["n_copies"] in (0, 1) for r in out) and {r["domain"] for r in out} == {"web", "curated"}


def test_very_long_texts_and_ties_of_the_order(docs, by_id):
    """Rows of one doc_id share a place in the order; a text of 300,000 words takes its whole length."""
    rows = [(1, "w " * 300_000, "en", "s1"), (2, "w " * 10, "en", "s1"), (3, "w " * 10, "en", "s1")]
    out = by_id(mix(docs(rows), {}, 20.0))
    assert (out[1]["n_copies"], out[2]["n_copies"] + out[3]["n_copies"]) in {(0, 0), (0, 1), (0, 2)}
    twice = mix(docs([(1, "a b", "en", "s1"), (1, "a b", "en", "s1")]), {}, 1.0).collect()
    assert [r["n_copies"] for r in twice] == [1, 1]
