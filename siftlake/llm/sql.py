"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

SPLIT = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Exact Jaccard indices of all pairs that share a shingle, and the smallest doc_id reachable over links.
MINHASH = rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, {SPLIT.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 OR ws IS NULL THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), arcs AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT a, a AS c FROM arcs UNION SELECT r.a, arcs.b FROM r JOIN arcs ON arcs.a = r.c),
m AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""

PASSAGES = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, coalesce({SPLIT.format("text")}, []) AS ws FROM documents),
g AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (g) WHERE first < doc_id),
l AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
t AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM k),
o AS (SELECT t.doc_id, string_agg(x, ' ' ORDER BY t.i) AS kept FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.i = t.i WHERE c.i IS NULL GROUP BY t.doc_id)
SELECT k.doc_id, len(ws)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM k LEFT JOIN o ON o.doc_id = k.doc_id
"""
