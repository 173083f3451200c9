"""SQL of the numbered queries that SQL can express over whole tables."""

from __future__ import annotations

from .common import LOWER, UPPER

_FOLD = f"translate(text, '{UPPER}', '{LOWER}')"
_SPACE = r"[\x20\x09-\x0D]+"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce({_FOLD}, ''), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(coalesce({_FOLD}, ''), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bi AS (SELECT item_id, ws, CAST(least(len(ws), 10) AS BIGINT) AS n FROM b WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS s FROM (SELECT item_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM bi)),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw))),
hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN iw USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce({_FOLD}, ''), '{_SPACE}'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
g AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS c FROM documents UNION SELECT g.x, r.c FROM r JOIN g ON g.y = r.x),
m AS (SELECT x AS doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

SEARCH = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, unnest(regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT CAST(count(DISTINCT r) AS BIGINT) AS n_docs, CAST(count(*) AS BIGINT) AS n_terms FROM d),
n AS (SELECT r, doc_id, 10 + (90 * CAST(count(*) AS BIGINT) * (SELECT n_docs FROM s)) // (SELECT n_terms FROM s) AS m FROM d GROUP BY 1, 2),
f AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM d WHERE t IN (SELECT t FROM b) GROUP BY 1, 2),
w AS (SELECT t, CAST(floor(1000 * ln((2 * (SELECT n_docs FROM s) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f GROUP BY 1),
k AS (SELECT item_id, n.r, n.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM b JOIN f USING (t) JOIN w USING (t) JOIN n ON n.r = f.r GROUP BY 1, 2, 3),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score FROM k WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""

FILL_IN_MIDDLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
g AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b, CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM t),
p AS (SELECT doc_id, text, n, least(a, b) AS lo, greatest(a, b) AS hi, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
c AS (SELECT *, substr(text, 1, lo) AS x, substr(text, lo + 1, hi - lo) AS y, substr(text, hi + 1) AS z FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT DISTINCT h, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS digest FROM p),
m AS (SELECT html, max(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN m ON m.html = p.html JOIN d USING (h)
"""
