"""DuckDB SQL of the operators that SQL can express over whole tables."""

from __future__ import annotations

SUBSTRING = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, UNNEST(ws) AS word, GENERATE_SUBSCRIPTS(ws, 1) AS pos FROM w),
v AS (SELECT doc_id, pos, STRING_AGG(word, ' ') OVER f AS k, COUNT(*) OVER f AS n FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
h AS (SELECT doc_id, pos, md5(k) AS k FROM v WHERE n = 50),
m AS (SELECT k, MIN(doc_id) AS least FROM h GROUP BY k),
s AS (SELECT h.doc_id, h.pos FROM h JOIN m ON h.k = m.k WHERE h.doc_id > m.least),
c AS (SELECT p.doc_id, p.pos, p.word, MAX(s.pos) OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS near FROM p LEFT JOIN s ON s.doc_id = p.doc_id AND s.pos = p.pos),
g AS (SELECT doc_id, COUNT(*) AS n_words, COUNT(near) AS n_removed, COALESCE(STRING_AGG(word, ' ' ORDER BY pos) FILTER (near IS NULL), '') AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(COALESCE(n_words, 0) AS BIGINT) AS n_words, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM w LEFT JOIN g ON g.doc_id = w.doc_id
"""

_WORDS = r"regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
x AS (SELECT item_id, ws, UNNEST(range(1, GREATEST(LEN(ws) - 9, 1) + 1)) AS a FROM b WHERE LEN(ws) > 0),
i AS (SELECT DISTINCT item_id, array_to_string(ws[a:a + 9], ' ') AS k, LEAST(LEN(ws), 10) AS size FROM x),
sizes AS (SELECT DISTINCT size FROM i),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, UNNEST(ws) AS word, GENERATE_SUBSCRIPTS(ws, 1) AS pos FROM d),
l AS (SELECT doc_id, pos, STRING_AGG(word, ' ') OVER f AS k, COUNT(*) OVER f AS n FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
q AS (SELECT doc_id, pos, size, CASE WHEN size = n THEN k ELSE array_to_string(string_split(k, ' ')[1:size], ' ') END AS k FROM l, sizes WHERE n >= size),
o AS (SELECT q.doc_id, q.pos, q.size, i.item_id FROM q JOIN i ON i.size = q.size AND i.k = q.k),
r AS (SELECT doc_id, pos, MAX(pos + size) AS stop FROM o GROUP BY doc_id, pos),
c AS (SELECT p.doc_id, p.pos, MAX(r.stop) OVER (PARTITION BY p.doc_id ORDER BY p.pos) AS stop FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.pos = p.pos),
n AS (SELECT doc_id, COUNT(*) AS n_words, COUNT_IF(stop > pos) AS n_hit FROM c GROUP BY doc_id),
t AS (SELECT doc_id, COUNT(*) AS n_items, STRING_AGG(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(COALESCE(n_words, 0) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit, CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items, sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SEARCH = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
sized AS (SELECT doc_id, len(t)::HUGEINT AS n FROM doc WHERE len(t) > 0),
totals AS (SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS terms FROM sized),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
tf AS (SELECT doc_id, t, count(*)::HUGEINT AS tf FROM (SELECT doc_id, unnest(t) AS t FROM doc) WHERE t IN (SELECT t FROM item) GROUP BY ALL),
weight AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::HUGEINT AS w FROM (SELECT t, count(*)::HUGEINT AS df FROM tf GROUP BY t), totals),
part AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS s FROM tf JOIN weight USING (t) JOIN sized USING (doc_id), totals),
score AS (SELECT item_id, doc_id, sum(s) AS score FROM part JOIN item USING (t) GROUP BY ALL HAVING sum(s) > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score) WHERE rank <= 10
"""

DIVERGENCE = f"""
WITH doc AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWERED}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
word AS (SELECT i, lang, source, unnest(t) AS t FROM doc),
kept AS (SELECT lang, t FROM word GROUP BY lang, t HAVING count(DISTINCT i) >= 30),
terms AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, t, count(*)::HUGEINT AS c FROM word JOIN kept USING (lang, t) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM doc),
total AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM grp LEFT JOIN counts USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, t, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 5)) // (n + 5 * v) AS p
      FROM total JOIN terms USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, t)),
q AS (SELECT lang, t, 1 + (1000000000 * (c + 5)) // (n + 5 * v) AS q
      FROM (SELECT lang, t, sum(c)::HUGEINT AS c FROM counts GROUP BY ALL) JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM total GROUP BY ALL) USING (lang) JOIN terms USING (lang)),
differ AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
         FROM grp AS a JOIN grp AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN differ AS d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
term AS (SELECT lang, source, 'term' AS part, t AS item, p - q AS value FROM p JOIN q USING (lang, t) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "binary") AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
