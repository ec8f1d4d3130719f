"""SQL of the queries that SQL can express, over the same tables."""

from __future__ import annotations

import string

from . import mixing

_LOW = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(words[i : i + 4], 'string_agg', ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON d.doc_id = c.a"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS z FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.z, c.z) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""


#: Every document with a term of an item is scored.
RANKED_DOCUMENTS = f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM d),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term, nn),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
c AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // l))))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (doc_id), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0) WHERE rank <= 10"""

#: Every document goes through every order: its first failing filter there removes it.
FILTER_AUDIT = """WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
f AS (SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
regexp_matches(t, '[#$%&*|]') AS d, coalesce(w.doc_id > low, false) AS e, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, good, toxic, count(*) AS n, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) + CAST(e AS INT) AS fails,
list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS failed FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), o AS (SELECT p.f || q.f || r.f || s.f || t.f AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
u AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o), v AS (SELECT *, substr(filter_order, step, 1) AS f FROM u),
h AS (SELECT g.*, filter_order, list_min(list_transform(failed, lambda y: strpos(filter_order, y))) AS gone FROM g, o),
k AS (SELECT h.part, v.filter_order, v.step, v.f, CAST(sum(CASE WHEN gone IS NULL OR gone > step THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN gone = step THEN n ELSE 0 END) AS BIGINT) AS removed,
CAST(sum(CASE WHEN gone < step AND list_contains(failed, v.f) THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails = 1 AND failed[1] = v.f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
CAST(sum(CASE WHEN gone = step AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN gone = step AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost FROM h JOIN v USING (filter_order) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM k"""


def mixing_sql() -> str:
    """The fitting rounds and the factor's steps, one after another."""
    dims = mixing.DIMENSIONS
    topic = "CASE WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, '$$$') OR contains(t, '###') THEN 'symbols' WHEN contains(t, '!! ') THEN 'shouting' WHEN contains(t, 'License') THEN 'notice' WHEN length(t) >= 2000 THEN 'long' ELSE 'short' END"
    steps = [
        "b AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents)",
        f"d AS (SELECT doc_id, source, lang, {topic} AS topic, CAST(length(t) - length(replace(replace(replace(t, ' ', ''), chr(9), ''), chr(10), '')) + 1 AS BIGINT) AS tokens FROM b)",
        f"c AS (SELECT {', '.join(dims)}, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL)",
    ]
    for x in dims:
        steps.append(f"t_{x} AS (SELECT {x}, part / sum(part) OVER () AS {x}_target FROM (SELECT {x}, pow(CAST(sum(tokens) AS DOUBLE), {mixing.TEMPER}) AS part FROM c GROUP BY {x}))")
    steps.append("r0 AS (SELECT *, CAST(tokens AS DOUBLE) AS weight FROM c " + " ".join(f"JOIN t_{x} USING ({x})" for x in dims) + ")")
    n = 0
    for _ in range(mixing.ROUNDS):
        for x in dims:
            steps.append(f"r{n + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(weight) OVER w > 0 THEN weight * {x}_target / sum(weight) OVER w ELSE 0 END AS weight) FROM r{n} WINDOW w AS (PARTITION BY {x}))")
            n += 1
    steps.append(f"g AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS ratio FROM r{n})")
    steps.append(f"f0 AS (SELECT {mixing.SHARE} * CAST(sum(tokens) AS DOUBLE) AS factor, {mixing.SHARE} * CAST(sum(tokens) AS DOUBLE) AS want FROM g)")
    for k in range(mixing.STEPS):
        steps.append(f"f{k + 1} AS MATERIALIZED (SELECT greatest(factor, coalesce((want - coalesce((SELECT sum(tokens) FROM g WHERE factor * ratio >= 1), 0)) / (SELECT sum(weight) FROM g WHERE factor * ratio < 1), factor)) AS factor, want FROM f{k})")
    draw = "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE)"
    return f"""WITH {", ".join(steps)}, p AS (SELECT source, lang, topic, least(CAST(1 AS DOUBLE), (SELECT factor FROM f{mixing.STEPS}) * ratio) AS p FROM g)
SELECT doc_id, documents.source, documents.lang, topic, d.tokens, round(p, 6) AS probability, {draw} < p AS kept FROM d JOIN p USING (source, lang, topic) JOIN documents USING (doc_id)"""
