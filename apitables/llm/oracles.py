"""SQL answers of the training-data queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op4_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '<\|im_start\|>|<\|im_end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>', '\0..', 'g')) AS n_text,
    length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<\|im_start\|>|<\|im_end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>', '\0..', 'g')) AS n_role
  FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_role + n_text + 24) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

ORACLES["op6_benchmark_decontamination"] = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
sized AS (SELECT item, w, least(13, len(w)) AS l FROM item WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS s FROM sized, unnest(range(1, len(w) - l + 2)) AS t(i)),
lengths AS (SELECT DISTINCT l FROM windows),
spots AS (SELECT r, i, l, array_to_string(w[i:i + l - 1], ' ') AS s FROM doc, lengths, unnest(range(1, len(w) - l + 2)) AS t(i)),
hits AS (SELECT r, i, l, item FROM spots JOIN windows USING (l, s)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, l FROM hits) AS h, unnest(range(i, i + l)) AS t(p) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) AS h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

ORACLES["op7_line_dedup"] = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
windows AS (
  SELECT r, doc_id, i, lines[i:i + 2] AS w FROM doc, unnest(range(1, len(lines) - 1)) AS t(i)
  WHERE regexp_matches(array_to_string(lines[i:i + 2], ''), '[^ \t\r\f\v]')),
ranked AS (SELECT r, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM windows),
covered AS (SELECT r, list(DISTINCT p) AS gone FROM ranked, unnest(range(i, i + 3)) AS t(p) WHERE n > 1 GROUP BY r)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN text ELSE array_to_string([lines[p] FOR p IN range(1, len(lines) + 1) IF NOT list_contains(gone, p)], chr(10)) END) AS text_sha256
FROM doc LEFT JOIN covered USING (r)
"""

# Documents have distinct ids here, so no shard has pages.
ORACLES["op8_sharding"] = """
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(strlen(text), 0) AS n, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
placed AS (SELECT r, doc_id, n, CAST(d AS INTEGER) AS d, h >> CAST(60 - d AS BIGINT) AS prefix FROM doc, range(0, 61) AS t(d)),
totals AS (SELECT *, sum(n) OVER (PARTITION BY d, prefix) AS total, count(*) OVER (PARTITION BY d, prefix) AS n_rows FROM placed),
shortest AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d) AS k FROM totals WHERE total <= 1048576 OR n_rows = 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, d AS shard_depth, CAST(prefix AS BIGINT) AS shard_prefix, CAST(0 AS BIGINT) AS shard_page FROM shortest WHERE k = 1
"""

ORACLES["op11_phrase_collocations"] = r"""
WITH doc AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
piece AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM doc, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS s(p)),
gram AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM piece, range(1, 5) AS a(m), unnest(range(1, len(w) - m + 2)) AS b(i)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM gram GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 30),
parts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM cand, range(1, 4) AS t(k) WHERE k < m),
cut AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, CAST((CAST(c.a AS HUGEINT) * 2000000) // (l.f + r.f) AS BIGINT) AS score
  FROM parts AS c JOIN f AS l ON l.lang = c.lang AND l.phrase = c.lp JOIN f AS r ON r.lang = c.lang AND r.phrase = c.rp),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM cut) WHERE o = 1),
kept AS (
  SELECT * FROM best AS b WHERE NOT EXISTS (
    SELECT 1 FROM cand AS c WHERE c.lang = b.lang AND len(c.phrase) > len(b.phrase) AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.a >= 80 * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
