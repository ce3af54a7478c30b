"""DuckDB SQL for the operators that SQL can express, written from their contracts."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', '')) AS body,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 4
      ELSE 14 + length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '[', ''), ']', '')) END AS marks FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(body + marks) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples
FROM sized GROUP BY conv_id"""

OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
hits AS (SELECT rid, i, n, item FROM (
    SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
  ) JOIN windows USING (n, s)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)"""

OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(4, len(w)) AS n FROM d WHERE len(w) > 0))),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM shared JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x, y FROM edge UNION SELECT r.x, b.y FROM reach r JOIN edge b ON r.y = b.x),
lowest AS (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM d LEFT JOIN size USING (doc_id) LEFT JOIN lowest USING (doc_id)"""

OP12 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS turn FROM documents),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT source, cap AS source_size, 3 * cap AS cap, k, CAST((k - 1) % 3 + 1 AS HUGEINT) AS weight FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap / weight, k) AS place FROM w),
levels AS (SELECT *, (SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM r),
level AS (SELECT rest, weights FROM levels WHERE rest * weight < cap * weights ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, k, CASE WHEN (SELECT rest FROM level) IS NULL OR cap * (SELECT weights FROM level) <= weight * (SELECT rest FROM level) THEN CAST(cap AS DOUBLE)
  ELSE CAST(weight * (SELECT rest FROM level) AS DOUBLE) / CAST((SELECT weights FROM level) AS DOUBLE) END AS target FROM r),
q AS (SELECT row_number() OVER () AS rid, doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, k, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, least(size, greatest(CAST(floor(target) AS BIGINT) - copy * source_size - sent, 0)) AS words, CAST(copy * source_size + sent + size AS DOUBLE) / target AS finish FROM q, range(3) AS copies(copy) WHERE target > 0),
m AS (SELECT *, coalesce(sum(words) OVER (ORDER BY finish, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM c WHERE words > 0),
n AS (SELECT rid, CAST(sum(words) AS BIGINT) AS taken, min(finish) AS finish, CAST(min(position) AS BIGINT) AS position FROM m GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, finish, position FROM q LEFT JOIN n USING (rid)"""

OP13 = r"""
WITH RECURSIVE rule AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || list_transform(range(8), lambda k: 0::BIGINT), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
runs AS (SELECT id, run, count(*) AS k FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY 1, 2),
hashed AS (SELECT run, k, xor(list_reduce([4294967295] || flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c) - 64] END)),
  lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs, rule),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, k FROM hashed) WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
cuts AS (SELECT DISTINCT word, n, place, left(word, place) || substr(word, place + 2) AS rest FROM (SELECT word, n, CAST(unnest(range(length(word))) AS INT) AS place FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM pairs GROUP BY 1),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM formed UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT w.word, w.root FROM walk w JOIN formed f ON f.word = w.root WHERE f.form IS NULL) USING (word)"""

ORACLE_SQL = {"op5_chat_formatting": OP5, "op6_decontamination": OP6, "op10_near_duplicates": OP10, "op12_source_mix": OP12, "op13_spelling_variants": OP13}
