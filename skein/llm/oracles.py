"""DuckDB SQL for the operators that SQL can express."""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), u AS (
  SELECT *, contains(r, '</s>') OR contains(x, '</s>') OR contains(r, ' [/INST]')
      OR regexp_matches(r, '<\\+/?s>|\[\\+/?INST\]') OR regexp_matches(x, '<\\+/?s>|\[\\+/?INST\]') AS conflict,
    len(regexp_extract_all(r, '<\\*/?s>|\[\\*/?INST\]')) + len(regexp_extract_all(x, '<\\*/?s>|\[\\*/?INST\]')) AS marks
  FROM t
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(10 + length(r) + 8 + length(x) + 4 + CASE WHEN conflict THEN marks ELSE 0 END) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id
"""

SUBSTRING = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i FROM d),
h AS (SELECT s.doc_id, s.i, md5(array_to_string(w[s.i:s.i + 34], ' ')) AS k FROM s JOIN d ON s.doc_id = d.doc_id),
c AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
g AS (SELECT doc_id, list_sort(list(i)) AS starts FROM h WHERE k IN (SELECT k FROM c) GROUP BY doc_id),
p AS (SELECT d.doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
x AS (SELECT DISTINCT doc_id, unnest(range(b, b + 35)) AS i FROM (SELECT doc_id, unnest(starts) AS b FROM g)),
k AS (SELECT p.doc_id, count(*) AS n, count(x.i) AS gone, string_agg(word, ' ' ORDER BY p.i) FILTER (x.i IS NULL) AS kept
  FROM p LEFT JOIN x ON p.doc_id = x.doc_id AND p.i = x.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

ARCHIVES = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x, strlen(coalesce(html, '')) AS n FROM pages),
h AS (SELECT x, max(page_id) AS head FROM p WHERE n >= 1000 GROUP BY x)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.x) AS payload_digest,
  CASE WHEN head IS NULL OR head IS NOT DISTINCT FROM p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN head IS DISTINCT FROM p.page_id THEN head END AS refers_to
FROM p LEFT JOIN h ON p.n >= 1000 AND p.x = h.x
"""

ORACLES: dict[str, str] = {"op1_substring_dedup": SUBSTRING, "op3_chat_formatting": CHAT, "op11_warc": ARCHIVES}
