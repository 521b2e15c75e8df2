"""SQL for the corpus queries that SQL can express."""

from __future__ import annotations

import math

from nimbostrat.llm import mixing, quality_rules, secrets

EXACT_DEDUP = """
    WITH d AS (
        SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
        FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
    FROM d JOIN g USING (text_sha256)
"""


def ngram_join(width: int = 3, percent: int = 90) -> str:
    """Links by shared shingles, and the smallest document that each one reaches."""
    return f"""
    WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= {width} THEN [array_to_string(w[i:i + {width - 1}], ' ') FOR i IN range(1, len(w) - {width - 2})] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS v, doc_id AS r FROM d UNION SELECT e.b, r.r FROM r JOIN e ON e.a = r.v),
    m AS (SELECT v, min(r) AS component_id FROM r GROUP BY v)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d JOIN m ON m.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    """


def _weights(level: str, table: dict[str, float]) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {w!r}" for k, w in table.items())
    return f"CASE {level} {arms} ELSE 1.0 END" if table else "1.0"


def _level(name: str, nodes: str, parents: str, above: list[str], level: str, table: dict[str, float]) -> str:
    """One level of budgeting: the share of each node of ``nodes`` in its parent's grant."""
    part = f"PARTITION BY {', '.join(above)}" if above else ""
    using = f"JOIN {parents} USING ({', '.join(above)})" if above else f"CROSS JOIN {parents}"
    before = f"({part} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{name}a AS (SELECT n.*, b, CASE WHEN cap > 0 THEN cap / ({_weights(level, table)}) ELSE 0 END AS ratio, CASE WHEN cap > 0 THEN {_weights(level, table)} ELSE 0 END AS lw FROM {nodes} n {using}),
    {name}b AS (SELECT *, coalesce(sum(cap) OVER {before}, 0) AS fb, sum(lw) OVER ({part}) - coalesce(sum(lw) OVER {before}, 0) AS lft FROM {name}a),
    {name}c AS (SELECT *, cap <= 0 OR fb + ratio * lft <= b * (1 + 1e-12) AS used FROM {name}b),
    {name} AS (SELECT {', '.join([*above, level])}, CASE WHEN used THEN cap ELSE (b - sum(CASE WHEN used THEN cap ELSE 0 END) OVER ({part})) * lw / sum(CASE WHEN used THEN 0 ELSE lw END) OVER ({part}) END AS b FROM {name}c)"""


def source_mixing(budget: float, epochs: float, seed: int) -> str:
    """Every document's copies; weights and tree as in ``mixing``."""
    number = "regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1)"
    return f"""
    WITH d AS (SELECT doc_id, lang AS l0, source AS s0, CASE WHEN {number} = '' THEN 'curated' WHEN CAST(nullif({number}, '') AS INTEGER) < 10 THEN 'web' ELSE 'curated' END AS domain,
            coalesce(lang, '{mixing.NONE}') AS lang, coalesce(source, '{mixing.NONE}') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tokens FROM documents),
    leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS size, CAST(sum(tokens) AS DOUBLE) * {epochs!r} AS cap FROM d GROUP BY ALL),
    l2 AS (SELECT domain, lang, sum(cap) AS cap FROM leaf GROUP BY ALL), l1 AS (SELECT domain, sum(cap) AS cap FROM leaf GROUP BY ALL),
    g0 AS (SELECT least(sum(size) * {budget!r}, sum(cap)) AS b FROM leaf),
    {_level("g1", "l1", "g0", [], "domain", mixing.DOMAIN_WEIGHTS)},
    {_level("g2", "l2", "g1", ["domain"], "lang", mixing.LANG_WEIGHTS)},
    {_level("g3", "leaf", "g2", ["domain", "lang"], "source", {})},
    p AS (SELECT domain, lang, source, size, CAST(floor(round(b, 3)) AS BIGINT) AS a FROM g3 JOIN leaf USING (domain, lang, source)),
    q AS (SELECT *, CASE WHEN size > 0 THEN a // size ELSE 0 END AS whole FROM p),
    k AS (SELECT d.*, whole, a - whole * size AS rest, md5('{seed}:' || whole || ':' || doc_id) AS key FROM d JOIN q USING (domain, lang, source)),
    c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id RANGE UNBOUNDED PRECEDING) AS upto FROM k)
    SELECT doc_id, domain, l0 AS lang, s0 AS source, CAST(whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS n_copies FROM c
    """


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def secret_scan(scope: int = secrets.SCOPE) -> str:
    """Spans by kind, then the links between those of one document."""
    keep = {
        "assign": f"length(regexp_extract(m[i], {_quoted(secrets.ASSIGN)}, 2)) >= 6",
        "candidate": "regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[A-Z]') AND regexp_matches(m[i], '[a-z]')",
    }
    kinds = []
    for n, kind in enumerate(secrets.KINDS, 1):
        pattern = _quoted(getattr(secrets, kind.upper()))
        kinds.append(
            f"""SELECT doc_id, {n} AS k, '{kind}' AS kind, sum(length(s[i]) + length(m[i])) OVER (PARTITION BY doc_id ORDER BY i) - length(m[i]) AS a,
            sum(length(s[i]) + length(m[i])) OVER (PARTITION BY doc_id ORDER BY i) AS b, {keep.get(kind, "true")} AS keep
            FROM (SELECT doc_id, string_split_regex(text, {pattern}) AS s, regexp_extract_all(text, {pattern}) AS m, unnest(generate_series(1, len(regexp_extract_all(text, {pattern})))) AS i FROM d)"""
        )
    near = lambda x, kinds, w: f"EXISTS (SELECT 1 FROM p o WHERE o.doc_id = {x}.doc_id AND o.kind IN ({kinds}) AND o.a < {x}.b + {w} AND o.b > {x}.a - {w})"
    base = "'assign', 'access', 'hex'"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), every AS ({" UNION ALL ".join(kinds)}), p AS (SELECT doc_id, k, kind, a, b FROM every WHERE keep),
    c AS (SELECT * FROM p WHERE kind = 'candidate' AND NOT {near("p", base, 0)} AND {near("p", "'access', 'login'", scope)}),
    r AS (SELECT * FROM p WHERE kind = 'assign' UNION ALL SELECT * FROM c),
    l AS (SELECT * FROM p WHERE kind IN ('login', 'endpoint') AND EXISTS (SELECT 1 FROM r WHERE r.doc_id = p.doc_id AND r.a < p.b + {scope} AND r.b > p.a - {scope})),
    s AS (SELECT * FROM p WHERE kind IN ({base}) UNION ALL SELECT * FROM c UNION ALL SELECT * FROM l),
    g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, k) FILTER (kind IN ({base})) AS base, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
    """


def quality() -> str:
    """Features by unnested windows; the binomial tail through the logarithm of the gamma function."""
    q = quality_rules
    word, space = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
    levels = ", ".join(f"({v}::DOUBLE)" for v in q.LEVELS)
    tail = f"""list_sum(list_transform(range(0, good_lost + 1), lambda i: exp(lgamma(n_good + 1.0) - lgamma(i + 1.0) - lgamma(n_good - i + 1.0) + i * {math.log(q.RISK)!r} + (n_good - i) * {math.log(1 - q.RISK)!r})))"""
    return f"""
    WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '{word}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM t),
    v AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
    d AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM v),
    n AS (SELECT r, sum(n)::BIGINT AS n FROM (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS n FROM d WHERE c > 1) GROUP BY r),
    f AS (SELECT w.r, doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{space}', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words,
        length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) AS up, length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g')) AS letters, len(l) AS lines
        FROM w LEFT JOIN n ON n.r = w.r),
    s AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, greatest(
        CASE WHEN word_chars > 0 THEN n_symbols * 10.0::DOUBLE / word_chars ELSE 0 END, CASE WHEN letters > 0 THEN up * 5.0::DOUBLE / letters ELSE 0 END,
        CASE WHEN lines > 0 THEN n_dup_lines * (10.0::DOUBLE / 3.0::DOUBLE) / lines ELSE 0 END, CASE WHEN n_words > 0 THEN n_repeat_words * 5.0::DOUBLE / n_words ELSE 0 END) AS score FROM f),
    g AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
    h AS (SELECT lang, score, good FROM s JOIN g USING (doc_id) WHERE NOT base_failed),
    c AS (SELECT lang, cutoff, count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_bad, count(*) FILTER (good AND score > cutoff) AS good_lost, count(*) FILTER (NOT good AND score > cutoff) AS bad_caught
        FROM h, (VALUES {levels}) AS level(cutoff) GROUP BY lang, cutoff),
    k AS (SELECT *, bad_caught * n_good - good_lost * n_bad AS gain FROM c
        WHERE n_good > 0 AND good_lost <= n_good * {q.RISK} AND {tail} <= {q.DELTA} / (SELECT count(DISTINCT coalesce(lang, chr(0))) FROM c WHERE n_good > 0)),
    b AS (SELECT lang, cutoff FROM k QUALIFY row_number() OVER (PARTITION BY lang ORDER BY gain DESC, cutoff DESC) = 1)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(score > cutoff, false) AS kept, score, cutoff
    FROM s LEFT JOIN b ON s.lang IS NOT DISTINCT FROM b.lang
    """


def vector_clusters(k: int = 16, rounds: int = 3) -> str:
    """Rounds of nearest centroids and their floored means, each a few tables."""
    parts = [f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(greatest(least(64 * x::DOUBLE, 134217728), -134217728)) AS BIGINT)) AS q
        FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    m AS (SELECT q, count(*) AS n, row_number() OVER () AS g FROM v GROUP BY q),
    c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, q) - 1 AS c, q FROM v QUALIFY c < {k})"""]  # fmt: skip
    near = "SELECT g, q, n, c, d FROM (SELECT m.g, m.q, m.n, x.c, list_sum(list_transform(list_zip(m.q, x.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM m, c{0} x) QUALIFY row_number() OVER (PARTITION BY g ORDER BY d, c) = 1"
    for k_ in range(rounds):
        parts.append(f"""a{k_} AS ({near.format(k_)}),
    s{k_} AS (SELECT c, i, sum(x * n)::BIGINT AS t, sum(n)::BIGINT AS n FROM (SELECT c, n, unnest(q) AS x, unnest(range(64)) AS i FROM a{k_}) GROUP BY c, i),
    u{k_} AS (SELECT c, list((t - ((t % n) + n) % n) // n ORDER BY i) AS q FROM s{k_} GROUP BY c),
    c{k_ + 1} AS (SELECT o.c, coalesce(u.q, o.q) AS q FROM c{k_} o LEFT JOIN u{k_} u ON u.c = o.c)""")
    parts.append(f"""e AS ({near.format(rounds)}),
    i AS (SELECT c, sum(d * n)::BIGINT AS cluster_inertia FROM e GROUP BY c)""")
    return f"""WITH {", ".join(parts)}
    SELECT v.vec_id, e.c::INTEGER AS cluster, e.d AS distance, i.cluster_inertia, (SELECT sum(cluster_inertia)::BIGINT FROM i) AS inertia, sha256(array_to_string(f.q, ',')) AS centroid_sha256
    FROM v JOIN e ON e.q = v.q JOIN i ON i.c = e.c JOIN c{rounds} f ON f.c = e.c
    """


def conversation_trie() -> str:
    """Prefixes as joined digests; each node meets the nodes on its first member's path."""
    # crc32 by the bits of each byte; 3988292384 is its polynomial
    bit = "if(c % 2 = 1, xor(c // 2, 3988292384), c // 2)"
    crc = f"xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: list_reduce(range(8), lambda c, k: {bit}, xor(a, b)), 4294967295), 4294967295)"
    return f"""
    WITH o AS (SELECT conv_id, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS x, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w, turn FROM conversations WHERE conv_id IS NOT NULL),
    t AS (SELECT conv_id, x, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, x) - 1 AS pos FROM o),
    c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, {crc} % 4 AS h FROM t),
    a AS (SELECT c.conv_id, 0 AS own, pos, x, w FROM c JOIN t ON t.conv_id = c.base AND pos < h UNION ALL SELECT c.conv_id, 1, pos, x, w FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h),
    r AS (SELECT conv_id, w, row_number() OVER q AS depth, string_agg(x, '') OVER q AS p FROM a WINDOW q AS (PARTITION BY conv_id ORDER BY own, pos)),
    y AS (SELECT conv_id, 0 AS w, 0 AS depth, '' AS p FROM c UNION ALL SELECT conv_id, w, depth, p FROM r),
    z AS (SELECT conv_id, max(depth) AS depth FROM y GROUP BY conv_id),
    n AS (SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w FROM y GROUP BY depth, p),
    l AS (SELECT y.conv_id, y.depth, n.conv_id AS node FROM y JOIN n ON n.depth = y.depth AND n.p = y.p),
    k AS (SELECT n.conv_id, n.depth, n.n_convs, n.w, l.node AS parent, (SELECT count(*) FROM n m JOIN l j ON j.conv_id = m.conv_id AND j.depth = n.depth WHERE m.depth = n.depth + 1 AND j.node = n.conv_id) AS n_children
        FROM n LEFT JOIN l ON l.conv_id = n.conv_id AND l.depth = n.depth - 1),
    s AS (SELECT l.node AS conv_id, l.depth, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((k.n_convs - 1) * k.w)::BIGINT AS saved_tokens
        FROM k JOIN l ON l.conv_id = k.conv_id AND l.depth <= k.depth GROUP BY 1, 2),
    e AS (SELECT l.node AS conv_id, l.depth, sha256(string_agg(l.conv_id::VARCHAR, ',' ORDER BY l.conv_id)) AS ends FROM z JOIN l ON l.conv_id = z.conv_id AND l.depth = z.depth GROUP BY 1, 2)
    SELECT k.conv_id, k.depth::BIGINT AS depth, k.parent AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
    FROM k JOIN s ON s.conv_id = k.conv_id AND s.depth = k.depth LEFT JOIN e ON e.conv_id = k.conv_id AND e.depth = k.depth
    """
