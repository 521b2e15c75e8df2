import hashlib
import random
import re

from nimbostrat.llm.secrets import secret_scan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


TEXTS = [
    "token = abc", "Token='abcdef1' é password:\"zzzzzzz\"", "secret=token:abcdefgh", "AKIA" + "A" * 16 + " x AKIAAKIA" + "B" * 12, "AKIA123 é" + "0a" * 12 + "g" + "f" * 23,
    "😀 api_key := q" + " api-key=123456 APIKEY= 1234567", None, "", "x" * 5000 + " passwd=" + "y" * 400 + "\n" + "password=" + "k" * 6, "token=key secret" + "=" + "deadbeef" * 5,
]


def test_base_spans_match_plain_patterns(docs, by_id):
    out = by_id(secret_scan(docs(list(enumerate(TEXTS)))))
    for k, text in enumerate(TEXTS):
        spans = base(text or "")
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        assert out[k]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (text, out[k])
        assert [out[k][f"n_{n}"] for n in ("assign", "access", "hex")] == [sum(s[2] == n for s in spans) for n in ("assign", "access", "hex")]


def test_weak_candidates_need_a_partner(docs, by_id):
    weak = "Zx9" * 12
    far = " filler" * 60
    rows = [(1, weak), (2, f"user: alice {weak}"), (3, f"user: alice{far} {weak}"), (4, f"https://host.example/x user=bob {weak}"), (5, "https://host.example/x"), (6, f"AKIA{'Q' * 16} {weak}")]
    out = by_id(secret_scan(docs(rows)))
    kinds = {k: [s.split(":")[0] for s in v["spans"].split(",") if s] for k, v in out.items()}
    assert kinds[1] == [] and kinds[3] == [] and kinds[5] == []
    assert sorted(kinds[2]) == ["candidate", "login"] and sorted(kinds[4]) == ["candidate", "endpoint", "login"] and sorted(kinds[6]) == ["access", "candidate"]
    text = dict(rows)[2]
    a, b = next(s for s in out[2]["spans"].split(",") if s.startswith("candidate")).split(":")[1:]
    assert text[int(a) : int(b)] == weak


def test_odd_tables(docs):
    assert secret_scan(docs([])).count() == 0
    twice = secret_scan(docs([(1, "token=abcdef"), (1, "token=abcdef"), (1, "none"), (None, "token=abcdef"), (None, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_assign"]) for r in twice) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 1)]


LOGIN = re.compile(r"""(user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+_.-]{3,})""", re.I | re.A)
ENDPOINT = re.compile(r"""(?:https?|ftp|s3|postgres|postgresql|mysql|redis|mongodb|amqp)://[^\x20\x09-\x0D"'<>]+""")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{32,}")


def linked(text, scope=160):
    """All spans of a text, every pair of parts compared."""
    parts = [(kind, a, b) for a, _, kind, b in base(text)]
    parts += [("login", m.start(), m.end()) for m in LOGIN.finditer(text)]
    parts += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    parts += [("candidate", m.start(), m.end()) for m in CANDIDATE.finditer(text) if all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]"))]
    near = lambda x, y, d: y[1] < x[2] + d and y[2] > x[1] - d
    of = lambda *kinds: [p for p in parts if p[0] in kinds]
    free = [c for c in of("candidate") if not any(near(c, b, 0) for b in of("assign", "access", "hex"))]
    weak = [c for c in free if any(near(c, p, scope) for p in of("access", "login"))]
    more = [p for p in of("login", "endpoint") if any(near(p, q, scope) for q in [*of("assign"), *weak])]
    kinds = ["assign", "access", "hex", "login", "endpoint", "candidate"]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted([*of("assign", "access", "hex"), *weak, *more], key=lambda s: (s[1], kinds.index(s[0]), s[2])))


def test_links_of_many_credentials_match_all_pairs(docs, by_id):
    """Hundreds of credentials in parts of all kinds, at distances on both sides of the scope's edge."""
    rng = random.Random(8)
    mixed = lambda n: "".join(rng.choices("abcdefXYZ0123456789", k=n - 3)) + "aB7"
    make = {
        "assign": lambda: f"password={mixed(9)}", "access": lambda: "AKIA" + "".join(rng.choices("ABC123", k=16)), "hex": lambda: "".join(rng.choices("0123456789abcdef", k=30)),
        "login": lambda: f"user: {mixed(6)}", "endpoint": lambda: f"https://h{rng.randrange(99)}.example/{mixed(5)}", "candidate": lambda: mixed(40), "covered": lambda: f"token={mixed(40)}",
    }
    rows = []
    for k in range(150):
        text = "é " * rng.randrange(3)
        for _ in range(rng.randrange(1, 9)):
            text += make[rng.choice(list(make))]() + " " * rng.choice([1, 2, 40, 157, 158, 159, 160, 161, 162, 200, 330])
        rows.append((k, text))
    out = by_id(secret_scan(docs(rows)))
    assert {k: r["spans"] for k, r in out.items()} == {k: linked(t) for k, t in rows}
    kinds = [s.split(":")[0] for r in out.values() for s in r["spans"].split(",") if s]
    assert min(kinds.count(k) for k in ("assign", "access", "hex", "login", "endpoint", "candidate")) > 20
    assert kinds.count("candidate") < sum(len(CANDIDATE.findall(t)) for _, t in rows)


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "token=abcdef", "x", 5, "y")], "doc_id bigint, text string, kind string, begin int, spans string")
    assert [r["spans"] for r in secret_scan(rows).collect()] == ["assign:0:12"]
