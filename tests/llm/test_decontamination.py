import random
import time

import numpy as np
import pytest

from nimbostrat.llm.decontamination import ItemIndex, find_leaks, merged, run_hashes, tiles, words_of

RNG = random.Random(11)
VOCABULARY = [f"v{k}" for k in range(3000)]
ITEMS = [(k, " ".join(RNG.choices(VOCABULARY, k=30 + k))) for k in range(12)] + [(90, None), (91, ""), (92, "only three words")]


def brute_tiles(text, item, least):
    """Greedy tiling by trying all positions each time."""
    marked_t, marked_i, out = set(), set(), []
    while True:
        best = None
        for i in range(len(text)):
            for j in range(len(item)):
                n = 0
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and i + n not in marked_t and j + n not in marked_i:
                    n += 1
                if n >= least and (best is None or n > best[0] or n == best[0] and (j, i) < (best[2], best[1])):
                    best = (n, i, j)
        if best is None:
            return out
        n, i, j = best
        marked_t.update(range(i, i + n))
        marked_i.update(range(j, j + n))
        out.append((i, j, n))


@pytest.mark.parametrize("seed", range(20))
def test_tiles_match_brute_force(seed):
    rng = random.Random(seed)
    text, item = [rng.randint(1, 4) for _ in range(60)], [rng.randint(1, 4) for _ in range(25)]
    seeds = [(i, j) for i in range(57) for j in range(22) if text[i : i + 4] == item[j : j + 4]]
    assert tiles(merged(np.array([(i - j, i, i) for i, j in seeds]).reshape(-1, 3)), 4) == brute_tiles(text, item, 4)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def test_whole_reordered_and_partial_passages(docs, by_id, items):
    passage = ITEMS[3][1].split()
    noise = lambda n: RNG.choices(VOCABULARY, k=n)
    rows = [
        (1, " ".join(noise(50) + passage + noise(50))),
        (2, " ".join(passage[16:] + noise(20) + passage[:16])),
        (3, " ".join(noise(100) + passage[: len(passage) // 2])),
        (4, " ".join(passage).upper() + "."),
        (5, None), (6, ""), (7, " ".join(noise(400))), (8, "it has only three words here"),
        (9, ITEMS[5][1] + " " + ITEMS[6][1]),
    ]
    out = by_id(find_leaks(docs(rows), items))
    assert {k: v["contaminated"] for k, v in out.items()} == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False, 7: False, 8: True, 9: True}
    assert out[2]["item_id"] == 3 and out[2]["n_tiles"] == 2 and out[9]["n_items"] == 2 and out[7]["coverage"] == 0


def test_blocks_give_the_same_result(docs, by_id, items):
    rows = [(k, ITEMS[k][1]) for k in range(12)] + [(50, ITEMS[1][1] + " " + ITEMS[9][1])]
    assert by_id(find_leaks(docs(rows), items, block_words=20)) == by_id(find_leaks(docs(rows), items))


def test_odd_tables(spark, docs, items):
    assert find_leaks(docs([]), items).count() == 0
    assert not find_leaks(docs([(1, "x")]), items.limit(0)).first()["contaminated"]
    clash = docs([(1, ITEMS[0][1]), (1, ITEMS[0][1])]).withColumnRenamed("lang", "item_id").withColumnRenamed("source", "coverage")
    assert [r["contaminated"] for r in find_leaks(clash, items).collect()] == [True, True]


@pytest.mark.parametrize("block_words", [20, 2_000_000])
def test_items_that_share_an_id_or_have_none(spark, docs, by_id, block_words):
    texts = [" ".join(RNG.choices(VOCABULARY, k=40)) for _ in range(4)]
    items = spark.createDataFrame([(5, texts[0]), (5, texts[1]), (None, texts[2]), (None, texts[3]), (7, texts[3])], "item_id bigint, text string")
    rows = [*enumerate(texts), (4, " ".join(RNG.choices(VOCABULARY, k=40))), (6, texts[0] + " " + texts[1])]
    out = by_id(find_leaks(docs(rows), items, block_words=block_words))
    assert {k: (v["contaminated"], v["item_id"], v["n_items"]) for k, v in out.items()} == {0: (True, 5, 1), 1: (True, 5, 1), 2: (True, None, 1), 3: (True, 7, 2), 4: (False, None, 0), 6: (True, 5, 2)}


def test_words():
    assert words_of("It's A_b 3.") == ["it", "s", "a_b", "3"]


def test_rolled_hashes_tell_runs_apart():
    ids = np.array([1, 2, 3, 1, 2, 3, 2, 1], np.uint64)
    h = run_hashes(ids, 3).tolist()
    assert h[0] == h[3] and len(set(h)) == 5 and not len(run_hashes(ids, 9))


@pytest.mark.parametrize("block_words", [30, 2_000_000])
def test_whole_operator_matches_brute_force(spark, docs, by_id, block_words):
    """Texts of few different words, so that seeds, tiles and partial leaks abound."""
    rng = random.Random(5)
    items = [(k, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 14)))) for k in range(25)]
    rows = []
    for k in range(80):
        words = rng.choices("abcdefgh", k=rng.randint(0, 30))
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items)[1].split()
            cut = rng.randint(0, len(part))
            words = words[:5] + part[cut:] + words[5:] + part[:cut]
        rows.append((k, " ".join(words)))
    out = by_id(find_leaks(docs(rows), spark.createDataFrame(items, "item_id bigint, text string"), block_words=block_words))
    for k, text in rows:
        want = []
        for item_id, item in items:
            words = item.split()
            found = brute_tiles(text.split(), words, min(5, len(words)))
            share = sum(n for _, _, n in found) / len(words)
            if share >= 0.8:
                want.append((-share, item_id, len(found)))
        best = min(want, default=(0.0, None, 0))
        assert (out[k]["n_items"], out[k]["coverage"], out[k]["item_id"], out[k]["n_tiles"]) == (len(want), -best[0], best[1], best[2]), k


def test_repetitive_and_very_long_texts():
    index = ItemIndex([(1, "la " * 400), (2, "one two three four five six")], 5)
    began = time.perf_counter()
    assert index.leaks("la " * 20_000, 0.8) == [(1, 1.0, 1)]
    assert index.leaks("la " * 300 + "x " * 300_000 + "one two three four five six", 0.8) == [(2, 1.0, 1)]
    assert time.perf_counter() - began < 30
