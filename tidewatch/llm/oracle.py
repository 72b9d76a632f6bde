"""DuckDB SQL for the registered queries of this subpackage, where SQL can express them."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"'[^\x20\x09-\x0D]+'"
_ITEM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_ITEM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_ITEM}) AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM bi),
di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k),
hit AS (SELECT doc_id, i, k, item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM di) JOIN bw USING (k, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k
"""

OP3 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS text FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

OP4 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d)),
r AS (SELECT doc_id, i, i - 400 > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS fresh FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM w) WHERE n > 1),
s AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
t AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM s GROUP BY ALL),
u AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM t GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN u.a IS NULL THEN h ELSE array_to_string(list_transform(list_zip(list_concat([0], u.b), list_concat(u.a, [length(h) // 2])), lambda z: substr(h, 2 * z[1] + 1, 2 * (z[2] - z[1]))), '') END)) AS kept_sha256
FROM d LEFT JOIN u ON d.doc_id = u.doc_id
"""

OP6 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {_WS}), '{_UPPER}', '{_LOWER}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.last IS NOT NULL AND f.last <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP7 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (SELECT count(*) - count(DISTINCT x) FROM (SELECT unnest(string_split(d.text, chr(10))) AS x) WHERE regexp_matches(x, {_WORD}))::BIGINT AS n_dup_lines,
             coalesce(rw.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN rw ON d.doc_id = rw.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT count(*)::DOUBLE AS hosts, sum(n)::DOUBLE AS total, sum(n * n)::DOUBLE AS squares, sum(f) / sum(n) AS m, sum(f * f / n) AS raw FROM h),
r AS (SELECT *, m * (1 - m) * (total - squares / total - (hosts - 1)) AS freedom FROM s),
prior AS (SELECT m, 1 / least(0.5, greatest(1e-6, CASE WHEN freedom > 0 THEN (raw - total * m * m - m * (1 - m) * (hosts - 1)) / freedom ELSE 0 END)) - 1 AS k FROM r),
bad AS (SELECT source FROM h, prior WHERE (f + k * m) / (n + k) > m + 0.5 * (1 - m))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM b
"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, sum(strlen(s)) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(strlen(a.s)) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE c >= 0.8 * (x.n + y.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT doc_id, min(other) AS class_id FROM r GROUP BY doc_id
"""

_BS = "chr(92)"
_ESC = f"replace(replace(replace(%s, {_BS}, {_BS} || {_BS}), '### ', '#' || {_BS} || '## '), '</turn>', '<' || {_BS} || '/turn>')"

OP9 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, x.turn, x.role, {_BS} || '### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(turn, role)),
u AS (SELECT *, {_ESC % 'text'} AS etext, replace({_ESC % 'role'}, ': ', ':' || {_BS} || ' ') AS erole FROM t),
e AS (SELECT *, contains(text, '### ') OR contains(text, '</turn>') OR contains(role, '### ') OR contains(role, '</turn>') OR contains(role, ': ')
             OR regexp_replace(text, '(?s)[\\\\](.)', '\\1', 'g') <> text OR regexp_replace(role, '(?s)[\\\\](.)', '\\1', 'g') <> role AS bad FROM u),
g AS (SELECT *, bool_or(bad) OVER (PARTITION BY conv_id) AS escaped FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(14 + CASE WHEN escaped THEN length(erole) + length(etext) ELSE length(role) + length(text) END)::BIGINT AS formatted_chars
FROM g GROUP BY conv_id
"""

# The crc32 table's entry of a byte, and the crc32 of a string's bytes (one list_reduce over them, then inverted).
_STEP = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
_RUN = "'[A-Za-zÀ-ÿ]+'"

OP13 = f"""
WITH RECURSIVE t(i, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, {_STEP}, k + 1 FROM t WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS entries FROM t WHERE k = 8),
r AS (SELECT doc_id, translate(run, '{_UPPER}', '{_LOWER}') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), {_RUN})) AS run FROM documents)),
f AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM r GROUP BY doc_id, run),
g AS (SELECT f.*, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda j: ('0x' || h[2 * j + 1:2 * j + 2])::BIGINT), lambda c, b: xor(c // 256, entries[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295) AS crc FROM f, crc),
w AS (SELECT CASE WHEN crc % 199 = 0 THEN run[1:crc % length(run)] || run[crc % length(run) + 2:] ELSE run END AS word, n FROM g),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
a AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
b AS (SELECT word, n, word[1:i - 1] || '_' || word[i + 1:] AS hole, word[1:i - 1] || word[i + 1:] AS less FROM a),
e AS (SELECT x.word, y.word AS near, y.n AS near_n FROM b x JOIN b y ON x.hole = y.hole AND x.word <> y.word
      UNION SELECT b.word, v.word, v.n FROM b JOIN v ON b.less = v.word UNION SELECT v.word, b.word, b.n FROM b JOIN v ON b.less = v.word),
m AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM e GROUP BY word),
p AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 5 * v.n THEN top END AS form_n,
             CASE WHEN top >= 5 * v.n THEN (SELECT min(near) FROM e WHERE e.word = v.word AND near_n = top) END AS form FROM v LEFT JOIN m ON v.word = m.word),
way(word, r) AS (SELECT word, word FROM p UNION ALL SELECT way.word, p.form FROM way JOIN p ON way.r = p.word WHERE p.form IS NOT NULL)
SELECT p.word, form, r AS root, n, n_near, form_n::BIGINT AS form_n FROM p JOIN way ON p.word = way.word AND r IN (SELECT word FROM p WHERE form IS NULL)
"""

ORACLE = {"op1_decontaminate": OP1, "op2_warc": OP2, "op3_substring_dedup": OP3, "op4_suffix_dedup": OP4, "op6_line_dedup": OP6, "op7_quality_rules": OP7, "op8_probminhash": OP8, "op9_chat_format": OP9, "op13_spelling_variants": OP13}
