import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from nimbostrat.llm import common, conversation_trie
from nimbostrat.llm.conversation_trie import conversation_trie as trie
from nimbostrat.llm.conversation_trie import ends_digests, ordered_turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, p0 string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()), (r, t)))
    own = {c: [x for _, x in sorted(v, key=lambda e: e[0])] for c, v in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        path = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h]  # remainders have the sign of c, as in SQL
        path = tuple(path + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = [sums[x] for x in children[p]]
        sums[p] = (sum(x[0] for x in below) or 1, (len(members[p]) - 1) * words + sum(x[1] for x in below))
    return sorted(
        ((members[p][0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), *sums[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()), key=repr
    )


def result(spark, rows):
    df = trie(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _rows(seed, n=60):
    rng, rows = random.Random(seed), []
    for c in range(n):
        base = rng.randrange(3)
        rows += [(c, t, rng.choice(["user", "assistant", None]) if rng.random() < 0.1 else "user", f"word {base if rng.random() < 0.8 else rng.randrange(9)} of {t}") for t in range(rng.randrange(8))]
    return rows


EDGES = [
    (None, 0, "user", "nobody"), (5, None, "user", "first"), (5, 0, None, None), (5, 0, "user", "tie"), (5, 0, "assistant", "tie"), (5, 3, "user", "twice"), (5, 3, "user", "twice"),
    (0, 1, "user", "a"), (20, 1, "user", "a"), (21, 1, "user", "only one turn"), (41, 1, "user", "base absent"), (41, 2, "user", "x y z"), (-3, 1, "user", "a"), (1 << 60, 1, "user", "a"), (25, -4, "", ""), (25, -4, "", ""),
]


@pytest.mark.parametrize("rows", [_rows(1), _rows(2) + EDGES, EDGES, EDGES[:1], []], ids=["random", "mixed", "edges", "null id", "empty"])
def test_against_plain_tree(spark, rows):
    assert result(spark, rows) == plain(rows)


def test_hot_conversation_and_prefix(spark, monkeypatch):
    """A conversation of a third of the turns, one text shared by many, with small bounds for what counts as frequent."""
    monkeypatch.setattr(common, "SPREAD_ROWS", 3)
    monkeypatch.setattr(conversation_trie, "BLOCK", 16)
    monkeypatch.setattr(conversation_trie, "CHUNK", 3)
    rows = [(2, t, "user", f"t{t}") for t in range(150)] + [(c, t, "system", f"same {t}") for c in range(40, 100) for t in range(4)] + _rows(3, 40)
    assert result(spark, rows) == plain(rows)


def test_places_across_parts(spark):
    """A conversation of equal and null turns still gets each place once."""
    rows = [(1, None, "user", "x")] * 300 + [(1, 1, "user", str(k)) for k in range(300)] + [(2, 1, "user", "y")]
    got = ordered_turns(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()
    assert sorted(r["at"] for r in got if r["conv_id"] == 1) == list(range(600))
    assert all(r["words"] == 1 for r in got)


def test_ends_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK", 2)
    rows = [(k, c) for k in range(3) for c in random.Random(k).sample(range(-50, 2000), 1 if k == 2 else 200)]
    got = {r["key"]: r["ends_sha256"] for r in ends_digests(spark.createDataFrame(rows, "key bigint, conv_id bigint"), ["key"]).collect()}
    for k in range(3):
        assert got[k] == hashlib.sha256(",".join(str(c) for c in sorted(c for x, c in rows if x == k)).encode()).hexdigest()


def test_long_text(spark):
    rows = [(c, 0, "user", "w " * 300_000) for c in (0, 1, 2)]
    assert result(spark, rows) == plain(rows)
