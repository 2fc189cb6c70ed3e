"""SQL of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
RUNS = f"regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+')"

CHAT = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(15 + length(role) + length(text)
        + length(role) - length(replace(replace(replace(role, chr(92), ''), '<', ''), chr(10), ''))
        + length(text) - length(replace(replace(text, chr(92), ''), '<', ''))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

DECONTAMINATION = f"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS} AS w FROM benchmark),
j AS (SELECT item, w, least(len(w), 10) AS n FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[s.s:s.s + n - 1], ' ') AS win FROM j CROSS JOIN range(1, 100000) s(s) WHERE s.s <= len(w) - n + 1),
d AS (SELECT doc_id, {WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (SELECT doc_id, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS p, w FROM d CROSS JOIN sizes),
hit AS (SELECT doc_id, p, spot.n, win.item FROM spot JOIN win ON win.n = spot.n AND win.win = array_to_string(w[p:p + spot.n - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) x GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) x GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {RUNS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS p FROM d) y),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS m FROM d UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.m),
g AS (SELECT v, min(m) AS component FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component AS component_id, d.doc_id = component AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN g ON g.v = d.doc_id
"""

LINE_DEDUP = """
WITH l AS (SELECT doc_id, unnest(w) AS line, unnest(range(len(w))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents) d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.line, k.pos, s.holder IS NOT NULL AND s.holder <> k.doc_id AS gone FROM k LEFT JOIN s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

#: The checksum's table, and one step of it over the text in hexadecimal h.
CRC = """bits AS (SELECT i, 0 AS k, i AS c FROM range(256) r(i)
    UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crc AS (SELECT i, c AS x FROM bits WHERE k = 8)"""
STEP = "substr(h, 3), xor(c // 256, x) FROM steps JOIN crc ON crc.i = xor(c % 256, 16 * (strpos('0123456789ABCDEF', h[1]) - 1) + strpos('0123456789ABCDEF', h[2]) - 1) WHERE h <> ''"

RESAMPLING = f"""
WITH RECURSIVE {CRC},
d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT {WORDS} AS w FROM benchmark),
df AS (SELECT doc_id, unnest(list_concat(w, [w[p] || ' ' || w[p + 1] for p in range(1, len(w))])) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, [w[p] || ' ' || w[p + 1] for p in range(1, len(w))])) AS f FROM b),
names AS (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf) u),
steps AS (SELECT f, hex(f) AS h, 4294967295 AS c FROM names
    UNION ALL SELECT f, {STEP}),
bucket AS (SELECT f, xor(c, 4294967295) % 10000 AS k FROM steps WHERE h = ''),
s AS (SELECT k, count(*) AS n FROM df JOIN bucket USING (f) GROUP BY 1),
t AS (SELECT k, count(*) AS n FROM bf JOIN bucket USING (f) GROUP BY 1),
gain AS (SELECT k.k, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM df) + 10000.0::DOUBLE) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM bf) + 10000.0::DOUBLE)))) AS g FROM range(10000) k(k) LEFT JOIN s ON s.k = k.k LEFT JOIN t ON t.k = k.k),
mean AS (SELECT doc_id, floor(sum(g) / count(*)) AS weight FROM df JOIN bucket USING (f) JOIN gain ON gain.k = bucket.k GROUP BY 1),
scored AS (SELECT d.doc_id, len(w) AS n_words, len(w) + greatest(len(w) - 1, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN mean ON mean.doc_id = d.doc_id),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_words >= 20)
SELECT scored.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, place AS rank
FROM scored LEFT JOIN placed ON placed.doc_id = scored.doc_id AND place <= 25 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100
"""

SEARCH = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
it AS (SELECT DISTINCT item_id, unnest({WORDS}) AS term FROM benchmark),
tf AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) x WHERE term IN (SELECT term FROM it) GROUP BY 1, 2, 3),
a AS (SELECT CAST(count(*) FILTER (WHERE len(w) > 0) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT docs FROM a) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf GROUP BY 1),
i AS (SELECT doc_id, tf.term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))) AS impact FROM tf JOIN w ON w.term = tf.term CROSS JOIN a),
s AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM it JOIN i ON i.term = it.term GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM r WHERE place <= 10
"""

MEASURES = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
a AS (SELECT doc_id, unnest(w) AS a, unnest(range(len(w))) AS p FROM d),
g AS (SELECT doc_id, p, a || ' ' || lead(a, 1) OVER o || ' ' || lead(a, 2) OVER o AS g FROM a WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
o AS (SELECT doc_id, g FROM g WHERE g IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT g.doc_id, unnest([p, p + 1, p + 2]) AS q FROM g JOIN o ON o.doc_id = g.doc_id AND o.g = g.g) x GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) x WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) for x in w]), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
"""

BASE_SCORES = f"""
WITH RECURSIVE {CRC},
steps AS (SELECT doc_id, hex(CAST(doc_id AS VARCHAR)) AS h, 4294967295 AS c FROM documents UNION ALL SELECT doc_id, {STEP}),
fold AS (SELECT doc_id, xor(c, 4294967295) % 10 = 0 AS held_out FROM steps WHERE h = ''),
t AS (SELECT d.doc_id, held_out, unnest(list_append({RUNS}, chr(10))) AS token FROM documents d JOIN fold ON fold.doc_id = d.doc_id),
c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 4) AS base_score
FROM t LEFT JOIN c ON c.token = t.token CROSS JOIN n GROUP BY doc_id, held_out, n
"""

PHRASES = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
a AS (SELECT doc_id, unnest(w) AS a, unnest(range(len(w))) AS p FROM d),
b AS (SELECT doc_id, p, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM a WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
l AS (SELECT doc_id, p, CASE WHEN a = 'mit' AND b = 'license' THEN 'mit' WHEN a = 'apache' AND b = 'license' THEN 'apache' WHEN a = 'general' AND b = 'public' AND c = 'license' THEN 'gpl' END AS label FROM b),
f AS (SELECT doc_id, count(*) AS n, min(p) AS lo, max(p) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM l WHERE label IS NOT NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN f ON f.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_prefix_tree": CHAT, "op2_decontamination": DECONTAMINATION, "op4_near_duplicates": NEAR_DUPLICATES, "op11_line_dedup": LINE_DEDUP, "op12_importance_resampling": RESAMPLING, "op13_ranked_search": SEARCH, "quality_measures": MEASURES, "lm_base_scores": BASE_SCORES, "license_phrases": PHRASES}
