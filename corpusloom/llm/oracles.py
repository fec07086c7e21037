"""DuckDB SQL for the rows of the queries that SQL can express, stated independently of the operators' methods."""

from __future__ import annotations

from corpusloom.llm import licenses, warc

WORD = r"'[^\x20\x09-\x0D]+'"

CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(regexp_replace(role, '[\\<#:]', 'XX', 'g')) + length(regexp_replace(text, '[\\<#:]', 'XX', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
CAST(sum(length('### ') + n + length(': ') + length('</turn>') + 1) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
"""

SUBSTRING = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 11))) AS i FROM w),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM p),
f AS (SELECT g, min(doc_id) AS m FROM k GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM k JOIN f USING (g) WHERE m < doc_id),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
y AS (SELECT x.doc_id, word, x.pos, gone.pos IS NOT NULL AS out FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.pos = x.pos),
z AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE out) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT out), '') AS kept FROM y GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN z USING (doc_id)
"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORD})) AS BIGINT) AS size, substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0::DOUBLE, 1.0, 2.0][1 + CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INT)] AS w, row_number() OVER (ORDER BY source IS NULL, source) AS pos FROM d GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(w) OVER () AS all_w FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (all_w - coalesce(sum(w) OVER b, 0)) AS level FROM c WINDOW b AS (ORDER BY ratio, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT level AS final FROM l WHERE ratio > level ORDER BY ratio, pos LIMIT 1),
t AS (SELECT source, source_size, coalesce(CASE WHEN final IS NULL OR ratio <= final THEN cap ELSE final * w END, 0) AS target FROM l LEFT JOIN o ON true),
b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS passes FROM t),
r AS (SELECT d.*, b.source_size, b.target, b.passes, b.budget - b.passes * b.source_size AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size, source_size, target, CAST(passes * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken FROM r
"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND list_sum(list_transform(embedding, lambda e: CASE WHEN e IS NULL OR NOT isfinite(e) THEN 1 ELSE 0 END)) = 0 AND list_sum(list_transform(embedding, lambda e: abs(e))) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a),
c AS (SELECT node AS vec_id, min(root) AS component_id FROM r GROUP BY node)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n_shingles FROM s), x AS (SELECT doc_id, unnest(sh) AS g FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 90 * (p.n_shingles + q.n_shingles - shared)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, n_shingles, component_id FROM n JOIN c USING (doc_id)
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {LOWER} AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL), m AS (SELECT lang, sum(c) AS m FROM c GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (coalesce(n, 0) + v) AS p
FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 1)) // (any_value(m) + any_value(v)) AS q FROM c JOIN m USING (lang) JOIN v USING (lang) GROUP BY ALL),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""


def license_sql() -> str:
    """The scan on the words themselves, without hashes."""
    rows = ", ".join(f"({i}, '{label}', {str(base).lower()}, {[w.decode() for w in words]!r})" for i, (label, base, words) in enumerate(licenses.templates()))
    grams = "unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS gram, unnest(range(0, len(ws) - 2))"
    return rf"""
WITH t(no, label, base, ws) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT rid, {grams} AS pos FROM d), tg AS (SELECT no, len(ws) AS size, {grams} AS spot FROM t),
h AS (SELECT rid, no, size, pos - spot AS diag, spot FROM p JOIN tg USING (gram)),
dg AS (SELECT rid, no, size, diag, count(*) AS n FROM h GROUP BY ALL),
b AS (SELECT *, sum(new) OVER (PARTITION BY rid, no ORDER BY diag) AS block FROM (
SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY rid, no ORDER BY diag) <= {licenses.MERGE} THEN 0 ELSE 1 END AS new FROM dg WHERE size >= {licenses.LONG} AND n > 1)),
l AS (SELECT rid, no, count(DISTINCT spot + k) / any_value(h.size) AS share FROM h JOIN b USING (rid, no, diag) CROSS JOIN (VALUES (0), (1), (2)) x(k) GROUP BY rid, no, block),
f AS (SELECT rid, no, diag, 1.0 AS share FROM dg WHERE size < {licenses.LONG} AND n = size - 2 UNION ALL SELECT rid, no, NULL, share FROM l WHERE share >= {licenses.LEAST}),
r AS (SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(diag) FILTER (WHERE base) AS first_word, max(diag) FILTER (WHERE base) AS last_word, max(share) AS score,
string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE share >= {licenses.ACCEPT}) AS labels FROM f JOIN t USING (no) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN r USING (rid)
"""


ORACLE_SQL = {
    "op1_warc_derivatives": warc.oracle_sql(),
    "op2_chat_formatting": CHAT,
    "op3_substring_dedup": SUBSTRING,
    "op4_mixing": MIXING,
    "op5_embedding_dedup": VECTORS,
    "op6_jaccard_join": JACCARD,
    "op11_source_divergence": DIVERGENCE,
    "op13_license_scan": license_sql(),
}
