"""DuckDB SQL of the operators that it can express, by brute force; for tables of some thousand rows."""

from __future__ import annotations

from . import chat

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All pairs that share a shingle, then everything reachable.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(root) AS component_id, s.doc_id = min(root) AS kept FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, len(s.s)
"""

#: All pairs of a label; what no traversal may miss more than a tenth of.
NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
r(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, min(root) AS component_id, v.vec_id = min(root) AS kept FROM v JOIN r ON r.node = v.vec_id GROUP BY v.vec_id
"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: The digest's 160 bits, five to a letter; of equal payloads the smallest page answers.
CAPTURES = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT page_id, strlen(h) AS n, list_reduce(list_transform(string_split(sha1(h), ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', (strpos('0123456789abcdef', c) - 1) * 4 + 1, 4)), lambda x, y: x || y) AS bits, min(page_id) OVER (PARTITION BY h) AS low FROM p),
d AS (SELECT *, list_reduce(list_transform(range(32), lambda i: substr('{_BASE32}', CAST(1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), lambda x, y: x || y) AS digest FROM b)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> low THEN low END AS refers_to FROM d
"""

SQL = {"op1_minhash_near_dedup": NEAR_DUPLICATES, "op5_multi_index_near_dedup": NEAR_VECTORS, "op7_perspective_chat": chat.DIGEST_SQL, "op9_warc_capture_index": CAPTURES}
