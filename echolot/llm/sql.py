"""DuckDB SQL for the queries that SQL can express in reasonable time on whole tables."""

from __future__ import annotations

#: Words as the contracts say.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

NEAR_DUPLICATES = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, greatest(len(w) - 3, 1) + 1)]) AS s, len(w) AS n FROM w),
sets AS (SELECT doc_id, CASE WHEN n = 0 THEN [] ELSE s END AS s FROM s),
g AS (SELECT doc_id, len(s) AS size, unnest(s) AS g FROM sets),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common, any_value(a.size) + any_value(b.size) AS total FROM g a JOIN g b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p WHERE 100 * common >= 80 * (total - common)),
sym AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT sym.y, reach.seen FROM reach JOIN sym ON sym.x = reach.node WHERE reach.seen < sym.y),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN c ON node = doc_id"""

QUALITY = rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, array_to_string(list(word) OVER r, ' ') AS g, count(*) OVER r AS n, lag(word) OVER (PARTITION BY doc_id ORDER BY i) = word AS echo FROM x WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
t AS (SELECT doc_id, i, echo, n = 8 AND count(*) FILTER (n = 8) OVER (PARTITION BY doc_id, g) > 1 AS twice FROM g),
v AS (SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered, echo FROM t),
r AS (SELECT doc_id, count(*) FILTER (covered) AS rep, count(*) FILTER (echo) AS echo FROM v GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
d AS (SELECT doc_id, count(*) AS lines, count(DISTINCT line) AS kinds FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(y) FOR y IN w]), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(lines - kinds, 0)::BIGINT AS n_dup_lines, coalesce(rep, 0)::BIGINT AS n_repeat_words, coalesce(echo, 0) AS echo, coalesce(lines, 0) AS lines FROM w LEFT JOIN r USING (doc_id) LEFT JOIN d USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_dup_lines > 3 * lines OR 10 * echo > 2 * n_words) AS kept FROM f"""

SUBSTRING = rf"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, word, array_to_string(list(word) OVER r, ' ') AS g, count(*) OVER r AS n FROM x WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
t AS (SELECT doc_id, i, word, n = 20 AND row_number() OVER (PARTITION BY g, n ORDER BY doc_id, i) > 1 AS again FROM g),
c AS (SELECT doc_id, i, word, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM t),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

SUFFIX = """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
x AS (SELECT doc_id, h, n, unnest(range(0, n)) AS i FROM b),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN i + 100 <= n THEN md5(substr(h, 2 * i + 1, 200)) END AS g FROM x),
t AS (SELECT doc_id, i, byte, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM g),
c AS (SELECT doc_id, i, byte, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM t),
r AS (SELECT doc_id, i, byte, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS head FROM c),
k AS (SELECT doc_id, count(*) FILTER (gone) AS gone, count(*) FILTER (head) AS spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM b LEFT JOIN k USING (doc_id)"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages), h AS (SELECT *, sha1(body) AS hex FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (k // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1) FOR k IN range(0, 32)], '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM h"""

TOP_K = """WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM p) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

CHAT = r"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS body, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss,
  sum(25 + length(role) + length(text) + length(role || text) - length(regexp_replace(role || text, '[<\[\\]', '', 'g')))::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(body) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a"""

LEXICAL = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
c AS (SELECT count(*)::BIGINT AS n_all, sum(len(w))::BIGINT AS l_all FROM d WHERE len(w) > 0),
x AS (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d),
b AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM x WHERE t IN (SELECT t FROM i) GROUP BY ALL),
v AS (SELECT t, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM b, c GROUP BY t, n_all),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_all) // l_all))))::BIGINT AS score FROM b JOIN v USING (t) JOIN i USING (t), c GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM p WHERE rank <= 10"""

#: CRC-32 of the digits of doc_id, by the table of its polynomial; words that are equal p words on, as islands of each text and p.
RUNS = rf"""WITH k AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS k),
h AS (SELECT doc_id, {_WORDS} AS w, xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(k[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS h FROM documents, k),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM h),
o AS (SELECT doc_id, n, CASE WHEN a < n THEN [CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END FOR i IN range(n)] ELSE w END AS w FROM a),
x AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM o),
e AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND a.i < b.i AND 4 * (b.i - a.i) <= a.n),
g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
l AS (SELECT doc_id, min(i) AS s, count(*) + q AS len, q FROM g GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, s, len, min(q) AS q FROM l GROUP BY ALL),
f AS (SELECT doc_id, count(*) AS n_runs, first(struct_pack(s, len, q) ORDER BY len DESC, s, q) AS top, sha256(string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q)) AS listed FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM r),
c AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS body FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, top.len::BIGINT AS length, top.q::BIGINT AS period, ((1000 * top.len) // top.q)::BIGINT AS exponent_milli,
  coalesce(listed, sha256('')) AS runs_sha256, coalesce(body, sha256('')) AS collapsed_sha256 FROM o LEFT JOIN f USING (doc_id) LEFT JOIN c USING (doc_id)"""
