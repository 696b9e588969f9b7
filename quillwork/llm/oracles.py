"""DuckDB SQL of the corpus queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
g AS (SELECT r, p, word, CASE WHEN p <= n - 34 THEN md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS h FROM w),
again AS (SELECT h FROM g WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
b AS (SELECT r, p, word, max(CASE WHEN again.h IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM g LEFT JOIN again ON again.h = g.h),
k AS (SELECT r, count(*) AS n, CAST(sum(gone) AS BIGINT) AS removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM b GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""

_MARKS = r"(\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|turn\|>|<\|text\|>|<\|end\|>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>)"
_ESCAPED = "length(regexp_replace({}, '" + _MARKS + r"', 'x\1', 'g'))"

OP4 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum({_ESCAPED.format('text')} + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 4 ELSE 23 + {_ESCAPED.format('role')} END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(ws[p:p + n - 1], ' ') AS said FROM
  (SELECT item, ws, least(13, len(ws)) AS n, unnest(generate_series(1, len(ws) - least(13, len(ws)) + 1)) AS p FROM i WHERE len(ws) > 0)),
w AS (SELECT r, len(ws) AS size, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
g AS (SELECT r, p, 13 AS n, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS said, size FROM w),
dw AS (SELECT r, p, n, said FROM g WHERE p <= size - 12
  UNION ALL SELECT r, p, n, array_to_string(ws[p:p + n - 1], ' ') FROM (SELECT r, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM iw WHERE n < 13) WHERE len(ws) >= n)),
m AS (SELECT dw.r, dw.p, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.said = iw.said),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(p, p + n - 1)) AS q FROM (SELECT DISTINCT r, p, n FROM m)) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""

OP8 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, len(ws) AS n, unnest(ws) AS a, generate_subscripts(ws, 1) AS p FROM d),
t AS (SELECT r, n, p, a, lead(a, 1) OVER x AS b, lead(a, 2) OVER x AS c FROM w WINDOW x AS (PARTITION BY r ORDER BY p)),
s AS (SELECT DISTINCT r, a || ' ' || b || ' ' || c AS e FROM t WHERE c IS NOT NULL UNION ALL SELECT r, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 2),
k AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT x.r AS a, y.r AS b, count(*) AS n FROM s x JOIN s y ON x.e = y.e AND x.r < y.r GROUP BY 1, 2),
l AS (SELECT a, b FROM pairs JOIN k ka ON ka.r = a JOIN k kb ON kb.r = b WHERE 100 * pairs.n >= 90 * (ka.n + kb.n - pairs.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(r, other) AS (SELECT r, r FROM k UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.other),
c AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.other GROUP BY 1)
SELECT doc_id, coalesce(k.n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM d LEFT JOIN k USING (r) LEFT JOIN c USING (r)
"""

OP11 = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS p FROM pages),
h AS (SELECT page_id, p > 0 AS ok, CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS rest FROM u),
q AS (SELECT page_id, ok, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1) AS query FROM h),
c AS (SELECT *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)[.]', '') || regexp_replace(path, '/+$', '') ||
  coalesce('?' || nullif(array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]*|ref|gclid|fbclid)=')), '&'), ''), '') AS canonical FROM q),
listed AS (SELECT DISTINCT canonical FROM c WHERE ok AND regexp_matches(host, '(^|[.])(spam-farm|cheap-pills|casino-win|free-bets|ads-track|adult-x)[.]')),
r(rule, verdict, at_host, at_path) AS (VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'),
  ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
f AS (SELECT c.*, rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC) AS k FROM (SELECT row_number() OVER () AS n, * FROM c) c
  LEFT JOIN r ON (host = at_host OR ends_with(host, '.' || at_host)) AND starts_with(path, at_path))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN ok AND canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM f WHERE k = 1
"""

OP12 = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
least_id AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
l AS (SELECT doc_id, CAST(bool_or(coalesce(quality = 1, false)) AS BIGINT) AS good, CAST(bool_or(coalesce(toxic = 1, false)) AS BIGINT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END +
  CASE WHEN 100 * len(regexp_extract_all(t.text, '[A-Z]')) > 2 * length(t.text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 8 ELSE 0 END +
  CASE WHEN coalesce(t.doc_id > first, false) THEN 16 ELSE 0 END AS fails
  FROM t JOIN least_id USING (text) LEFT JOIN l ON l.doc_id = t.doc_id),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, generate_series(1, 5) AS g(step)),
k AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
steps AS (SELECT k.part, filter_order, step, bit,
  coalesce(sum(n) FILTER (fails & (before + bit) = 0), 0) AS kept,
  coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS removed,
  coalesce(sum(n) FILTER (fails & before <> 0 AND fails & bit <> 0), 0) AS redundant,
  coalesce(sum(n) FILTER (fails = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS toxic_lost FROM k, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM steps
"""

#: crc32 of an ASCII text, byte by byte over the table of 256 remainders.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"

OP13 = rf"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(n, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) ORDER BY n) AS t FROM range(256) AS r(n)),
j AS (SELECT *, unnest(range(click_id % 3 + 1)) AS j FROM clicks WHERE click_id % 3 >= 0 AND arrived_at IS NOT NULL),
k AS (SELECT *, {_CRC.format("click_id || ':' || j")} AS c FROM j, crc),
h AS (SELECT click_id, CAST(floor(epoch_us(arrived_at) / 3600000000) AS BIGINT) + 6 * j * (c % 10) AS hour, c,
  sha256(coalesce(CAST(client_id AS VARCHAR), '') || '|' || coalesce(kind, '') || '|' || coalesce(CAST(CAST(floor(100 * value + 0.5) AS BIGINT) AS VARCHAR), '') || '|' ||
    coalesce(CAST(epoch_us(ts) AS VARCHAR), '') || '|' || coalesce(props, '') || '|' || (c % 3)) AS hash FROM k),
l AS (SELECT *, hour + (c // 10) % 200 AS late FROM h),
b AS (SELECT click_id, hour, hash, (late - min(late) OVER ()) * 10 // (max(late) OVER () - min(late) OVER () + 1) AS batch FROM l),
tops AS (SELECT k AS batch, (SELECT max(hour) FROM b WHERE b.batch < k) AS m FROM range(11) AS r(k)),
r AS (SELECT click_id, hour, hash, b.batch, row_number() OVER (PARTITION BY click_id ORDER BY b.batch, hour, hash) AS i FROM b JOIN tops USING (batch) WHERE m IS NULL OR hour >= m - 24),
w(click_id, i, start_hour, opener, first_i) AS (
  SELECT click_id, i, hour, hash, i FROM r WHERE i = 1
  UNION ALL SELECT r.click_id, r.i, CASE WHEN again THEN start_hour ELSE hour END, CASE WHEN again THEN opener ELSE hash END, CASE WHEN again THEN first_i ELSE r.i END
  FROM (SELECT r.*, w.start_hour, w.opener, w.first_i, hour <= start_hour + 48 AS again FROM w JOIN r ON r.click_id = w.click_id AND r.i = w.i + 1) AS r),
g AS (SELECT w.click_id, w.start_hour, w.opener, w.first_i, count(*) - 1 AS n_repeats, count(*) FILTER (r.hash <> w.opener) AS n_conflicts,
  coalesce(sum({_CRC.format("r.hash")}) FILTER (r.hash <> w.opener), 0) AS conflict_crc, min(r.batch) AS opened FROM w JOIN r USING (click_id, i), crc GROUP BY 1, 2, 3, 4),
n AS (SELECT g.*, (SELECT min(batch) - 1 FROM tops WHERE batch > opened AND g.start_hour + 48 < m - 24) AS expired,
  (SELECT r.batch FROM r WHERE r.click_id = g.click_id AND r.i = g.first_i + g.n_repeats + 1) AS followed FROM g)
SELECT click_id, start_hour, CAST(least(coalesce(expired, 9), coalesce(followed, 9), 9) AS BIGINT) AS closed_batch, n_repeats, n_conflicts, CAST(conflict_crc AS BIGINT) AS conflict_crc, opener AS hash FROM n
"""
