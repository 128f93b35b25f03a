"""DuckDB SQL for the queries that SQL can express over whole tables.

The others can't be: tilings, dictionaries, classifiers, tokenizers, tag-path statistics, xxHash and matches with places. They
are tested against brute-force versions or held-out accuracy.
"""

#: Links by an equi-join on shingles between distinct sets, components by a recursive closure over linked sets.
MINMAX_DEDUP = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\x0C\r]+'), lambda w: w <> '') AS words
  FROM documents
), shingled AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(1, CASE WHEN len(words) = 0 THEN 1 ELSE greatest(len(words) - 3, 1) + 1 END), lambda i: array_to_string(list_slice(words, i, i + 3), ' ')))) AS shingles
  FROM split
), marked AS MATERIALIZED (
  SELECT doc_id, len(shingles) AS n, md5(array_to_string(shingles, chr(10))) AS digest, shingles FROM shingled
), classes AS MATERIALIZED (
  SELECT digest, min(doc_id) AS id, any_value(n) AS n, any_value(shingles) AS shingles FROM marked WHERE n > 0 GROUP BY digest
), postings AS MATERIALIZED (
  SELECT id, n, hash(s) AS h, s FROM (SELECT id, n, unnest(shingles) AS s FROM classes)
), edges AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b
  FROM postings a JOIN postings b ON a.h = b.h AND a.s = b.s AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS MATERIALIZED (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach(id, other) AS (
  SELECT id, id FROM classes UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON r.other = e.a
), components AS (
  SELECT id, min(other) AS component FROM reach GROUP BY id
), named AS (
  SELECT m.doc_id, m.n, coalesce(c.component, m.doc_id) AS component
  FROM marked m LEFT JOIN (SELECT digest, component FROM classes JOIN components USING (id)) c ON m.n > 0 AND m.digest = c.digest
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component AS component_id, doc_id = component AS kept FROM named
"""

#: formatted_chars adds the template's marks, one character for each backslash and one for each control string.
CHAT_FORMAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), measured AS (
  SELECT *, role || text AS content,
    len(regexp_extract_all(role, '<\||</?s>|<</?SYS>>|</?(?:start|end)_of_turn>|\[/?INST\]')) + len(regexp_extract_all(text, '<\||</?s>|<</?SYS>>|</?(?:start|end)_of_turn>|\[/?INST\]')) AS controls
  FROM turns
), grouped AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length('<|turn|><|text|><|end|>') + length(content) + (length(content) - length(replace(content, chr(92), ''))) + controls) AS formatted_chars
  FROM measured GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM grouped
"""

#: Base32 takes four characters from five hexadecimal digits of the SHA-1.
WARC_ROUND_TRIP = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), hashed AS (
  SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM payloads
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, (k // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM hashed
"""

#: The words of each text, every tenth text made periodic by the crc32 of its id; equal words a quarter of the text apart at most,
#: joined and cut into islands of one distance; the least distance of each stretch is its period.
WORD_RUNS = r"""
WITH bits AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) t(i))),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k::INT, 1))::BIGINT)), lambda c, b: xor(c // 256, crcs[xor(c, b) % 256 + 1])), 4294967295) AS h FROM documents, bits),
a AS (SELECT doc_id, w0, len(w0) AS n, h, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w0) > 0 THEN (h // 10) % len(w0) END AS a FROM d),
p AS (SELECT doc_id, w0, n, a, 1 + (n - a) // (3 + g % 8) AS p FROM a),
words AS (SELECT doc_id, i, n, w0[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1] AS w FROM (SELECT *, unnest(range(n)) AS i FROM p)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= 6 AND length >= 4 * q GROUP BY doc_id, start, length),
best AS (SELECT doc_id, count(*) AS n_runs, max_by((start, length, period), (length, -start, -period)) AS r, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, r[1]::BIGINT AS start, r[2]::BIGINT AS length, r[3]::BIGINT AS period, (1000 * r[2] // r[3])::BIGINT AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256 FROM d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SQL = {"op4_minmax_dedup": MINMAX_DEDUP, "op5_chat_format": CHAT_FORMAT, "op10_warc_round_trip": WARC_ROUND_TRIP, "op12_word_runs": WORD_RUNS}
