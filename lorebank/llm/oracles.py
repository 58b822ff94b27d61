"""DuckDB SQL for the corpus queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op2_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

ORACLES["op7_chat_formatting"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '###|</turn>|<turn/>')) + 9
            + CASE WHEN opens THEN 6 + length(replace(replace(role, '\', '\\'), chr(10), '\n')) ELSE 0 END AS chars
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

ORACLES["op8_decontamination"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
  WHERE text IS NOT NULL AND item_id IS NOT NULL),
bl AS (SELECT item_id, w, least(13, len(w)) AS m FROM bw WHERE len(w) > 0),
bwin AS (SELECT DISTINCT item_id, m, array_to_string(w[k : k + m - 1], ' ') AS win FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM bl)),
lens AS (SELECT DISTINCT m FROM bwin),
dwin AS (
  SELECT doc_id, m, k, array_to_string(w[k : k + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM dw, lens)),
occ AS (SELECT doc_id, item_id, k, d.m FROM dwin d JOIN bwin b ON d.m = b.m AND d.win = b.win),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS pos FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLES["op9_warc"] = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex, coalesce(html, '') AS body FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS holder FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST('0x' || substr(hex, 1 + 10 * (i // 8), 10) AS BIGINT) >> (5 * (7 - i % 8))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM g
"""

# The generated pages hold one article each, with paragraphs, headings and inline tags; on them the general
# extractor has to give what this plain reading gives.
ORACLES["op10_html_text"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS art FROM pages),
b AS (
  SELECT page_id, url, list_filter(list_transform(string_split_regex(art, '</?(?:p|h1)>'), lambda x:
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks
  FROM a)
SELECT page_id, url, coalesce(array_to_string(blocks, chr(10)), '') AS text, CAST(length(coalesce(array_to_string(blocks, chr(10)), '')) AS BIGINT) AS n_chars FROM b
"""
