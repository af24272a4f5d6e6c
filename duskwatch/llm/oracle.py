"""DuckDB SQL for the registered queries that SQL can express on whole tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op1_decontaminate"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
cut AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i + 1 : i + 10], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM item WHERE len(w) > 0)),
spans AS (SELECT DISTINCT m FROM cut),
seen AS (
  SELECT doc_id, m, p, array_to_string(w[p + 1 : p + m], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(len(w) - m + 1)) AS p FROM words, spans WHERE len(w) >= m)),
hit AS (SELECT doc_id, p, m, item_id FROM seen JOIN cut USING (m, win)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
        FROM hit GROUP BY doc_id)
SELECT words.doc_id, len(w) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM words LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLE["op2_ngram_jaccard"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 3, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON reach.seen = links.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) c ON c.node = d.doc_id
"""

ORACLE["op5_url_filters"] = r"""
WITH rules(rhost, rpath, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fit AS (
  SELECT page_id, rhost || rpath AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM named JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT named.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM named LEFT JOIN fit ON fit.page_id = named.page_id AND k = 1
"""

ORACLE["op6_quality_rules"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
good AS (
  SELECT *, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    list_filter(ls, lambda l: NOT (
      20 * (length(l) - length(translate(l, '#*$%&|<>{}[]=~^_\!', ''))) > length(l)
      OR (length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) < 30 AND NOT regexp_matches(rtrim(l), '[.!?:;,…)\]"''”»。]$'))
      OR length(l) - length(translate(l, '|»›•·', '')) >= 2
      OR regexp_matches(lower(l), 'javascript|cookie policy|accept cookies|privacy policy|terms of use|terms of service|all rights reserved|click here|sign up for|subscribe to our|share this|read more|lorem ipsum'))) AS g
  FROM b),
win AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM b WHERE len(w) >= 5)),
twice AS (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM win JOIN twice USING (doc_id, k)) GROUP BY doc_id),
fig AS (
  SELECT good.doc_id, len(w) AS n_words, word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         word_chars - length(regexp_replace(array_to_string(g, ''), '[\x20\x09-\x0D]+', '', 'g')) AS lost_chars
  FROM good LEFT JOIN rep USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_chars <= 40 * word_chars AS kept FROM fig
"""

ORACLE["op10_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, ls[i + 1] AS l, i FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
win AS (
  SELECT doc_id, i AS s, lead(i, 2) OVER w AS e, concat(l, chr(10), lead(l, 1) OVER w, chr(10), lead(l, 2) OVER w) AS k
  FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win WHERE e IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM ranked WHERE r > 1),
rest AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, string_agg(l.l, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL) AS text
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(rest.text, '') END AS text
FROM documents d LEFT JOIN rest USING (doc_id)
"""

ORACLE["op13_fill_in_middle"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2,
         ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM t),
c AS (
  SELECT doc_id, text, w, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT *, array_to_string(w[1 : a], '') AS pre, array_to_string(w[a + 1 : b], '') AS mid, array_to_string(w[b + 1 : n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid)
                        ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
