"""DuckDB SQL of the queries that SQL can express (over the whole tables and texts)."""

from __future__ import annotations

# Insert all documents, revise all of them to the second tokenizer, delete the toxic ones.
TOKEN_ROLLUPS = r"""
WITH toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
docs AS (SELECT doc_id, source, lang, text,
                len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w1,
                len(regexp_extract_all(coalesce(text, ''),
                    '[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]|[!-/:-@\[-`{-~]')) AS w2 FROM documents),
changes AS (
  SELECT source, lang, 'words-1' AS tokenizer, 1 AS n, w1 AS k FROM docs
  UNION ALL SELECT source, lang, 'words-1', -1, -w1 FROM docs
  UNION ALL SELECT source, lang, 'words-2', 1, w2 FROM docs
  UNION ALL SELECT source, lang, 'words-2', -1, -w2 FROM docs WHERE doc_id IN (SELECT doc_id FROM toxic))
SELECT source, lang, tokenizer, CAST(sum(n) AS BIGINT) AS n_docs, CAST(sum(k) AS BIGINT) AS n_tokens
FROM changes GROUP BY ALL HAVING sum(n) <> 0 OR sum(k) <> 0
"""

DECONTAMINATION = r"""
WITH fold AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
grams AS (
  SELECT DISTINCT id AS item_id, n, array_to_string(w[p + 1:p + n], ' ') AS g
  FROM (SELECT id, w, least(10, len(w)) AS n, unnest(range(len(w) - least(10, len(w)) + 1)) AS p
        FROM fold WHERE side = 'b' AND len(w) > 0)),
windows AS (
  SELECT id AS doc_id, n, p, array_to_string(w[p + 1:p + n], ' ') AS g
  FROM (SELECT id, w, n, unnest(range(len(w) - n + 1)) AS p
        FROM fold, (SELECT DISTINCT n FROM grams) WHERE side = 'd' AND len(w) >= n)),
hits AS (SELECT doc_id, n, p, item_id FROM windows JOIN grams USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit
          FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT f.id AS doc_id, CAST(len(f.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM fold f LEFT JOIN words ON words.doc_id = f.id LEFT JOIN items ON items.doc_id = f.id WHERE f.side = 'd'
"""

URL_FILTERS = r"""
WITH rest AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
              FROM pages),
cut AS (SELECT page_id, html, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                        'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
parsed AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') AS key FROM cut),
listed AS (SELECT DISTINCT key FROM parsed WHERE host <> '' AND
             (4 * length(html) - length(replace(html, '###', '')) - length(replace(html, '***', ''))
              - length(replace(html, '$$$', '')) - length(replace(html, '%%%', ''))) / 3 >= 40),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
ruled AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
                 arg_max(r.verdict, length(rhost || rpath)) AS verdict
          FROM parsed JOIN rules r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
          GROUP BY page_id)
SELECT p.page_id, host, path, ruled.rule,
       coalesce(ruled.verdict, CASE WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed p LEFT JOIN ruled USING (page_id)
"""

EXACT_DEDUP = r"""
WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
       sha256(t) AS text_sha256
FROM norm WINDOW g AS (PARTITION BY t)
"""

# Damage (crc32 by its table), faults, then the cheapest edits per state, row by row.
TURN_REPAIR = r"""
WITH RECURSIVE
crc AS (SELECT list(c ORDER BY n) AS t FROM (
  SELECT n, list_reduce(list_prepend(n, range(8)),
                        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))),
coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':'
        || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS d FROM conversations, crc),
damaged AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), 'none') AS k, turn,
    CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded),
ordered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
faulty AS (SELECT *, CASE WHEN left(role, 1) = '' THEN ' ' ELSE left(role, 1) END AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
         WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'd'
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM ordered),
paired AS (SELECT *, lag(initial) OVER (PARTITION BY k ORDER BY i) || initial AS pair FROM faulty),
counts AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM paired GROUP BY k),
inserts(p, q, letters, price, lines) AS (VALUES (0, 0, '', 0, CAST([] AS VARCHAR[])), (1, 1, '', 0, []), (2, 2, '', 0, []),
    (3, 3, '', 0, []), (0, 2, 'I', 5, ['user:']), (1, 2, 'I', 5, ['user:']), (2, 3, 'I', 5, ['assistant:']),
    (3, 2, 'I', 5, ['user:']), (0, 3, 'II', 10, ['user:', 'assistant:']), (1, 3, 'II', 10, ['user:', 'assistant:'])),
edits(p, q, letter, price, own) AS (VALUES (0, 0, 'D', 2, NULL), (1, 1, 'D', 2, NULL), (2, 2, 'D', 2, NULL), (3, 3, 'D', 2, NULL),
    (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'), (1, 2, 'K', 0, 'u'), (3, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a'),
    (0, 2, 'R', 1, NULL), (1, 2, 'R', 1, NULL), (3, 2, 'R', 1, NULL), (2, 3, 'R', 1, NULL)),
best AS (
  SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, 0 AS state,
         {'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])} AS b FROM damaged
  UNION ALL
  SELECT x.k, x.i + 1, e.q, min({'cost': x.b.cost + g.price + e.price + CASE WHEN e.letter <> 'D' AND r.fault = 't' THEN 5 ELSE 0 END,
      'audit': x.b.audit || g.letters || e.letter,
      'lines': list_concat(x.b.lines, list_concat(g.lines, CASE e.letter WHEN 'D' THEN CAST([] AS VARCHAR[])
        WHEN 'K' THEN [r.role || ':' || r.text] ELSE [CASE e.q WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || r.text] END))})
  FROM best x JOIN paired r ON r.k = x.k AND r.i = x.i + 1 JOIN inserts g ON g.p = x.state JOIN edits e ON e.p = g.q
  WHERE e.letter = 'D' OR (r.fault NOT IN ('b', 'd') AND (e.letter = 'R' OR e.own = r.initial))
  GROUP BY x.k, x.i, e.q),
ended AS (SELECT k, min({'cost': b.cost + g.price, 'audit': b.audit || g.letters, 'lines': list_concat(b.lines, g.lines)}) AS b
  FROM best JOIN (SELECT k, max(i) AS i FROM paired GROUP BY k) n USING (k, i) JOIN inserts g ON g.p = state
  WHERE g.q IN (0, 3) GROUP BY k)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(e.b.cost, 0) AS BIGINT) AS cost,
       coalesce(e.b.audit, '') AS audit, sha256(coalesce(array_to_string(e.b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), 'none') AS k FROM conversations) a
LEFT JOIN counts USING (k) LEFT JOIN ended e USING (k)
"""
