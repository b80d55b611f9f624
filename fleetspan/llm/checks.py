"""DuckDB SQL that must give the same rows as the queries it is named after."""

from __future__ import annotations

_BLANKS = r"[\x20\x09-\x0D]+"
_ALL_WORDS = f"""SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANKS}'), lambda w: w <> '') AS words, coalesce(text, '') AS text FROM documents"""

_OP1 = f"""
WITH d AS ({_ALL_WORDS}),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d),
f AS (SELECT doc_id, pos, array_to_string(array_agg(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), ' ') AS gram,
             md5(array_to_string(array_agg(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 60 FOLLOWING), ' ')) AS wide,
             count(*) OVER (PARTITION BY doc_id) AS n FROM w),
r AS (SELECT doc_id, unnest(list_reduce(list(pos), (a, b) -> a, NULL)::BIGINT[]) AS pos FROM f WHERE false GROUP BY doc_id),
again AS (SELECT doc_id, gram FROM f WHERE pos <= n - 4 GROUP BY ALL HAVING count(*) > 1),
long AS (SELECT doc_id FROM f WHERE pos <= n - 60 GROUP BY doc_id, wide HAVING count(*) > 1),
hit AS (SELECT DISTINCT f.doc_id, f.pos + k.k AS pos FROM f JOIN again USING (doc_id, gram) CROSS JOIN range(5) k(k) WHERE f.pos <= f.n - 4),
rep AS (SELECT hit.doc_id, count(*) AS n, sum(length(w.word)) AS chars FROM hit JOIN w USING (doc_id, pos) GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
b AS (SELECT d.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(rep.chars, 0) AS chars
      FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND chars <= 0.2::DOUBLE * word_chars AND doc_id NOT IN (SELECT doc_id FROM long) AS kept
FROM b
"""
_OP1 = "\n".join(x for x in _OP1.split("\n") if not x.startswith("r AS"))

_CRC_TABLE = "tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t)"
_OP2 = f"""
WITH {_CRC_TABLE},
b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes FROM documents),
d AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_transform(bytes, lambda x: ('0x' || x)::BIGINT), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295)) AS crc FROM b, tab),
s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(size) OVER () AS total FROM d),
t AS (SELECT doc_id, size, crc, least(39, 40 * below // total)::INTEGER AS shard FROM s)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM t
"""

_SHINGLES = f"""
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANKS}'), lambda w: w <> '') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos, len(words) AS n FROM d),
g AS (SELECT doc_id, pos, n, array_to_string(array_agg(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), ' ') AS gram FROM w),
s AS (SELECT DISTINCT doc_id, gram FROM g WHERE pos <= greatest(n - 4, 1)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1)"""

_OP3 = f"""
WITH RECURSIVE {_SHINGLES},
often AS (SELECT gram FROM s GROUP BY 1 HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM (SELECT * FROM s SEMI JOIN often USING (gram)) a JOIN (SELECT * FROM s SEMI JOIN often USING (gram)) b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
c(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.doc_id)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, min(c.root) AS component_id FROM documents d LEFT JOIN z USING (doc_id) LEFT JOIN c USING (doc_id) GROUP BY d.doc_id, z.n
"""

# RE2 and Java read these alike; each match is taken with the gap before it, so that lengths give the places
_RULES = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key)[""''\"]?\x20*[:=]\x20*[\"'']?)([A-Za-z0-9+/_.=-]+)".replace('""', ""), 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]+)", 1, 24),
)


def _op4() -> str:
    parts = []
    for i, (kind, pattern, group, least) in enumerate(_RULES):
        ex = lambda p, g: f"regexp_extract_all(t, '{p}', {g})"
        parts.append(f"""{kind} AS (SELECT doc_id, {i} AS i, '{kind}' AS kind, unnest(list_zip({ex('(?s)(.*?)' + pattern, 1)}, {ex(pattern, 0)}, {ex(pattern, group)})) AS m, unnest(range(len({ex(pattern, 0)}))) AS k FROM d WHERE regexp_matches(t, '{pattern}')),
{kind}_at AS (SELECT doc_id, i, kind, m[2] AS whole, m[3] AS part, sum(length(m[1]) + length(m[2])) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM {kind}),
{kind}_ok AS (SELECT doc_id, i, kind, (e - length(whole))::BIGINT AS s, e::BIGINT AS e FROM {kind}_at WHERE length(part) >= {least})""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{','.join(parts)},
u AS (SELECT * FROM assign_ok UNION ALL SELECT * FROM access_ok UNION ALL SELECT * FROM hex_ok),
g AS (SELECT doc_id, count(*) FILTER (i = 0) AS n_assign, count(*) FILTER (i = 1) AS n_access, count(*) FILTER (i = 2) AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, i) AS spans FROM u GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


_OP6 = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower_az, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
sizes AS (SELECT DISTINCT least(10, len(words)) AS k FROM i WHERE len(words) > 0),
iw AS (SELECT item_id, k, array_to_string(words[p : p + k - 1], ' ') AS gram FROM (SELECT item_id, words, least(10, len(words)) AS k, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS p FROM i WHERE len(words) > 0)),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos, len(words) AS n FROM d),
dw AS (SELECT doc_id, k, pos, array_to_string(gram[:k], ' ') AS gram FROM (SELECT doc_id, pos, n, array_agg(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS gram FROM w) CROSS JOIN sizes WHERE pos <= n - k + 1),
m AS (SELECT DISTINCT doc_id, pos, k, item_id FROM dw JOIN iw USING (k, gram)),
h AS (SELECT doc_id, count(DISTINCT pos + j) AS n_hit FROM m CROSS JOIN range(10) r(j) WHERE j < k GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY 1)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_OP7 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, array_to_string(list_transform(range(8), lambda i: ('0x' || hex[5 * i + 1 : 5 * i + 5])::BIGINT).list_transform(lambda v:
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(v >> 15) + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> 10) & 31) + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> 5) & 31) + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(v & 31) + 1]), '') AS payload_digest,
      min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to, true AS intact FROM g
"""

_OP11 = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS name FROM conversations),
d AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_transform(name, lambda x: ord(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % 20 AS kind FROM k, tab),
v AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
r AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open FROM v),
f AS (SELECT *, again AND NOT blank AS duplicate, open AND NOT blank AND NOT again AS truncated, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS two FROM r),
g AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
next AS (SELECT * FROM (VALUES (0, 2), (1, 2), (3, 2), (2, 3)) x(s, h)),
pre AS (SELECT s, s AS h, 0 AS paid, '' AS pre FROM range(4) y(s) UNION ALL SELECT s, h, 3, 'I' FROM next),
ways AS (SELECT h, h AS z, 'D' AS letter, 4 AS paid, NULL::VARCHAR AS initial FROM range(4) y(h) UNION ALL SELECT s, h, 'R', 3, NULL::VARCHAR FROM next
         UNION ALL SELECT h, z, 'K', 0, initial FROM (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')) x(h, z, initial)),
edge AS (SELECT s, z, pre || letter AS letters, pre, letter, h, pre.paid + ways.paid AS paid, initial FROM pre JOIN ways USING (h)),
walk(conv_id, i, s, best) AS (
  SELECT conv_id, 0::BIGINT, 0::BIGINT, {'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]} FROM g
  UNION ALL
  SELECT w.conv_id, f.i, e.z::BIGINT, min({'cost': w.best.cost + e.paid + CASE WHEN f.truncated AND letter <> 'D' THEN 3 ELSE 0 END, 'audit': w.best.audit || e.letters,
    'said': w.best.said || CASE WHEN e.pre = 'I' THEN [CASE e.h WHEN 2 THEN 'user:' ELSE 'assistant:' END] ELSE [] END || CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE e.z WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] END})
  FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN edge e ON e.s = w.s AND (e.letter = 'D' OR NOT (f.blank OR f.duplicate)) AND (e.initial IS NULL OR e.initial = f.initial) GROUP BY w.conv_id, f.i, e.z),
ends AS (SELECT w.conv_id, min({'cost': w.best.cost + CASE w.s WHEN 2 THEN 3 ELSE 0 END, 'audit': w.best.audit || CASE w.s WHEN 2 THEN 'I' ELSE '' END, 'said': w.best.said || CASE w.s WHEN 2 THEN ['assistant:'] ELSE [] END}) AS b
         FROM walk w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.n = w.i WHERE w.s <> 1 GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

SQL = {"op1_repetition": _OP1, "op2_histogram_shards": _OP2, "op3_ngram_join": _OP3, "op4_secret_ledger": _op4(), "op6_leaked_items": _OP6, "op7_warc_chunks": _OP7, "op11_dialogue_repair": _OP11}
