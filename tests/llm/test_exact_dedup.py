import hashlib

from nimbostrat.llm.exact_dedup import exact_dedup, heavy_digests, digest


def test_groups_copies_and_keeps_the_largest_id(docs, by_id):
    rows = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "Äb"), (6, "äb"), (7, "ab ")]
    out = by_id(exact_dedup(docs(rows)))
    assert {k: (v["keep_id"], v["group_size"], v["kept"]) for k, v in out.items()} == {
        1: (2, 2, False), 2: (2, 2, True), 3: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True), 6: (6, 1, True), 7: (7, 1, True),
    }
    assert out[1]["text_sha256"] == hashlib.sha256(b"ab").hexdigest()


def test_hot_group_goes_through_the_broadcast(docs, by_id):
    rows = [(k, "same") for k in range(300)] + [(1000 + k, f"other {k // 2}") for k in range(300)]
    table = docs(rows)
    keyed = table.select("doc_id", digest().alias("text_sha256"))
    assert [r["group_size"] for r in heavy_digests(keyed).collect()] == [300]
    out = by_id(exact_dedup(table))
    assert all(out[k]["keep_id"] == 299 and out[k]["group_size"] == 300 for k in range(300))
    assert all(out[1000 + k]["group_size"] == 2 and out[1000 + k]["keep_id"] == 1001 + k // 2 * 2 for k in range(300))


def test_odd_tables(spark, docs):
    assert exact_dedup(docs([])).count() == 0
    repeated = exact_dedup(docs([(1, "x"), (1, "x"), (None, "y"), (None, "x")])).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in repeated if r["keep_id"]) == [(0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
    assert [(r["doc_id"], r["kept"]) for r in repeated if r["keep_id"] is None] == [(None, True)]
    clash = spark.createDataFrame([(1, "x", "a", True)], "doc_id bigint, text string, text_sha256 string, kept boolean")
    assert exact_dedup(clash).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
