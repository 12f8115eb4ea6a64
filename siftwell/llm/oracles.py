"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM w, range(1, greatest(len(ws) - 3, 2)) AS r(i) WHERE len(ws) > 0
),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.doc_id)
SELECT doc_id, coalesce(any_value(size.n), 0) AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept
FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id
"""

OP7 = rf"""
WITH dw AS (SELECT doc_id, {_PLAIN_WORDS} AS ws FROM documents),
iw AS (SELECT item_id, {_PLAIN_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS s
  FROM iw, range(1, greatest(len(ws) - 8, 2)) AS r(i) WHERE len(ws) > 0
),
lengths AS (SELECT DISTINCT m FROM windows),
places AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS s FROM dw, lengths, range(1, len(ws) - m + 2) AS r(i)),
found AS (SELECT doc_id, i, m, item_id FROM places JOIN windows USING (m, s)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, m FROM found), range(0, m) AS r(k) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s FROM w, range(1, len(ws) - 48) AS r(i)),
earliest AS (SELECT s, min(doc_id) AS d0 FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN earliest USING (s), range(0, 50) AS r(k) WHERE d0 < doc_id),
words AS (SELECT doc_id, p, ws[p] AS word FROM w, range(1, len(ws) + 1) AS r(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
