"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

from .licenses import PHRASES, TEMPLATES, THRESHOLD, needed, reach

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c'))
          + length(replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l')) + 14 AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP4 = f"""
WITH n AS (SELECT doc_id, {LOW} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""

#: Columns of the base measures; ``src`` has doc_id and text.
RULE_CTES = f"""
w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM src),
p AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT a.doc_id, a.i, count(*) OVER (PARTITION BY a.doc_id, a.x, b.x, c.x) AS n
      FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i = a.i + 1 JOIN p c ON a.doc_id = c.doc_id AND c.i = a.i + 2),
r AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) AS v(d) WHERE n > 1 GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        length(regexp_replace(text, '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]', '', 'g')) AS n_letters,
        len(list_filter(string_split(text, chr(10)), lambda x: ends_with(x, '...'))) AS n_ellipses,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
"""
KEPT = "NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR n_words > 100000 OR 10 * n_ellipses > 3 * n_lines OR 2 * n_letters < word_chars)"

OP7 = f"""
WITH src AS (SELECT doc_id, text FROM documents), {RULE_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {KEPT} AS kept FROM v
"""


def _op8() -> str:
    separators = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    templates = ", ".join(f"('{label}', {sorted(set(t.split()))!r}, {needed(len(set(t.split())), THRESHOLD)}, {reach(len(t.split()))})" for label, t in TEMPLATES)
    phrases = ", ".join(f"('{p}', {p.split()!r}, '{label}')" for p, label in PHRASES)
    words = "list_filter(regexp_split_to_array({}, '" + separators + "'), lambda x: x <> '')"
    return f"""
WITH t(label, words, need, size) AS (VALUES {templates}), ph(phrase, words, label) AS (VALUES {phrases}),
n AS (SELECT doc_id, {LOW} AS low FROM documents),
d AS (SELECT doc_id, low, {words.format("low")} AS ws FROM n),
hits AS (SELECT doc_id, label, unnest(list_filter(generate_series(1, len(ws)), lambda i: list_slice(ws, i, i + len(ph.words) - 1) = ph.words)) - 1 AS place
         FROM (SELECT doc_id, ws, ph.words, ph.label, phrase FROM d, ph WHERE contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || phrase || ' ')) ph),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM hits GROUP BY 1),
c AS (SELECT doc_id, ws, t.* FROM (SELECT doc_id, ws, list_distinct(ws) AS own FROM d), t WHERE len(list_intersect(own, words)) >= need),
w AS (SELECT doc_id, label, words, need, list_distinct(list_slice(ws, i, i + size - 1)) AS win FROM (SELECT *, unnest(generate_series(1, len(ws))) AS i FROM c)),
f AS (SELECT doc_id, label, max(len(list_intersect(win, words)) / len(words)) AS score FROM w WHERE len(list_intersect(win, words)) >= need GROUP BY 1, 2),
own AS (SELECT doc_id, list(label) AS labels, max(score) AS score FROM f GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
  round(CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(own.score, 0) END AS DOUBLE), 6) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)
"""


OP2 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 34), ' ') AS x
      FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY x) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
c AS (SELECT p.doc_id, p.i, word, coalesce(max(hit.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
      FROM p LEFT JOIN hit ON p.doc_id = hit.doc_id AND p.i = hit.i),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", LOW)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS x
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, CASE WHEN len(ws) > 0 THEN 1 ELSE 0 END))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.node = l.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(node) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1
"""

#: Bytes as pairs of hexadecimal digits.
OP9 = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, x, unnest(generate_series(1, CAST(length(x) / 2 AS BIGINT))) AS i FROM h),
g AS (SELECT doc_id, i, substr(x, 2 * i - 1, 2) AS byte, CASE WHEN 2 * i + 198 <= length(x) THEN md5_number(substr(x, 2 * i - 1, 200)) END AS win FROM b),
f AS (SELECT doc_id, i, byte, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS hit FROM g),
c AS (SELECT doc_id, i, byte, max(CAST(hit AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY 1)
SELECT doc_id, CAST(length(x) / 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM h LEFT JOIN k USING (doc_id)
"""

#: Arrivals of each batch, the batch that closes, kept turns, and the run from the first turn.
OP11 = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
  CAST('0x' || substr(sha256(coalesce(CAST(conv_id AS VARCHAR), '') || ':' || turn), 1, 8) AS BIGINT) AS h FROM conversations WHERE turn IS NOT NULL),
s AS (SELECT conv_id, turn, role, text, h % 8 AS batch FROM t UNION ALL SELECT conv_id, turn, 'user', text, (h + 3) % 8 FROM t WHERE h % 7 < 2),
a AS (SELECT batch, conv_id, turn, min({'p': role || '|' || text, 'r': role}) AS x FROM s GROUP BY ALL),
b AS (SELECT DISTINCT conv_id, batch FROM a),
g AS (SELECT conv_id, batch, coalesce(lead(batch) OVER (PARTITION BY conv_id ORDER BY batch), 99) - batch > 3 AS last FROM b),
c AS (SELECT conv_id, least(min(batch) FILTER (last) + 3, 8) AS closes FROM g GROUP BY 1),
f AS (SELECT conv_id, min(turn) AS first FROM t GROUP BY 1),
k AS (SELECT a.conv_id, turn, first, min(batch) AS batch, arg_min(x, batch) AS x FROM a JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id AND batch <= closes JOIN f ON a.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY ALL),
r AS (SELECT *, turn - first + 1 = row_number() OVER w AS run, max(batch) OVER w AS at_, lag(turn) OVER w = turn - 1 AND lag(x.r) OVER w = x.r AS broken FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT conv_id, max(turn) - min(first) + 1 - count(*) AS n_missing, count(*) FILTER (broken) AS n_breaks, coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (NOT run), '') AS left_ FROM r GROUP BY 1)
SELECT 'release' AS event, sha256(x.p) AS sha256, conv_id, turn, at_ AS batch, CAST(NULL AS BIGINT) AS n_missing, CAST(NULL AS BIGINT) AS n_breaks FROM r WHERE run
UNION ALL SELECT 'reject', sha256(x.p), a.conv_id, turn, batch, NULL, NULL FROM a JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id AND batch > closes
UNION ALL SELECT 'close', sha256(left_), e.conv_id, -1, closes, n_missing, n_breaks FROM e JOIN c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

#: The checksum bit by bit; then the cheapest edits row by row, with the repaired lines.
OP12 = r"""
WITH RECURSIVE n AS (SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) FOR z IN range(8)]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS h FROM n),
d AS (SELECT conv, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE h WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (SELECT *, left(role, 1) AS k, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS k0,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
ins(q, at_, c, l, lines) AS (VALUES (0, 0, 0, '', []), (0, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 5, 'I', ['user:']), (1, 3, 10, 'II', ['user:', 'assistant:']),
  (2, 2, 0, '', []), (2, 3, 5, 'I', ['assistant:']), (2, 2, 10, 'II', ['assistant:', 'user:']), (3, 3, 0, '', []), (3, 2, 5, 'I', ['user:']), (3, 3, 10, 'II', ['user:', 'assistant:'])),
act(at_, to_, k, l, c) AS (VALUES (0, 0, '', 'D', 2), (1, 1, '', 'D', 2), (2, 2, '', 'D', 2), (3, 3, '', 'D', 2), (0, 2, '', 'R', 1), (1, 2, '', 'R', 1), (3, 2, '', 'R', 1), (2, 3, '', 'R', 1),
  (0, 2, 'u', 'K', 0), (1, 2, 'u', 'K', 0), (3, 2, 'u', 'K', 0), (2, 3, 'a', 'K', 0), (0, 1, 's', 'K', 0)),
m AS (SELECT q, to_, k, act.l AS own, ins.c + act.c AS c, ins.l || act.l AS l, lines FROM ins JOIN act USING (at_)),
dp(conv, i, q, cost, audit, lines) AS (SELECT DISTINCT conv, CAST(0 AS BIGINT), 0, 0, '', CAST([] AS VARCHAR[]) FROM f
  UNION ALL SELECT conv, i, q, cost, audit, lines FROM (
    SELECT dp.conv, f.i, m.to_ AS q, dp.cost + m.c + CASE WHEN own <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS cost, dp.audit || m.l AS audit,
      list_concat(dp.lines, m.lines, CASE own WHEN 'D' THEN [] WHEN 'R' THEN [CASE m.to_ WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] ELSE [role || ':' || text] END) AS lines
    FROM dp JOIN f ON f.conv IS NOT DISTINCT FROM dp.conv AND f.i = dp.i + 1 JOIN m ON m.q = dp.q AND (m.k = '' OR m.k = f.k) AND (own = 'D' OR fault NOT IN ('blank', 'duplicate')))
  QUALIFY row_number() OVER (PARTITION BY conv, q ORDER BY cost, audit) = 1),
e AS (SELECT dp.conv, cost + c AS cost, audit || l AS audit, list_concat(dp.lines, ins.lines) AS lines FROM dp JOIN (SELECT conv, max(i) AS i FROM f GROUP BY 1) z ON z.conv IS NOT DISTINCT FROM dp.conv AND z.i = dp.i JOIN ins USING (q) WHERE at_ IN (0, 3)),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY conv ORDER BY cost, audit) = 1),
s AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (k0 || k NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.conv IS NOT DISTINCT FROM a.conv_id
"""

ORACLES = {
    "op2_substring_dedup": OP2,
    "op3_chat": OP3,
    "op4_exact_dedup": OP4,
    "op5_jaccard_join": OP5,
    "op7_quality_rules": OP7,
    "op8_license_scan": _op8(),
    "op9_suffix_dedup": OP9,
    "op11_turn_reassembly": OP11,
    "op12_conversation_repair": OP12,
}
