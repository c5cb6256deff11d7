"""DuckDB SQL for the registered queries, where SQL can express them."""

from __future__ import annotations

from promptmill.llm.license_scan import TEMPLATES, THRESHOLD, template_words

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

SUBSTRING_DEDUP = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
place AS (
  SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM doc WHERE len(w) >= 13) t),
earliest AS (SELECT gram, min(doc_id) AS first_id FROM place GROUP BY gram),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS at
  FROM (SELECT p.doc_id, p.s FROM place p JOIN earliest e ON p.gram = e.gram WHERE e.first_id < p.doc_id) t),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM doc),
kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.at) AS kept, count(*) AS n_kept
  FROM word w LEFT JOIN covered c ON w.doc_id = c.doc_id AND w.at = c.at WHERE c.at IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, len(d.w) - coalesce(k.n_kept, 0) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM doc d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {ALNUM_WORDS} AS w FROM benchmark),
piece AS (
  SELECT item_id, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS gram, least(13, len(w)) AS size
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM item WHERE len(w) > 0) t),
doc AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM piece),
place AS (
  SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM doc, sizes WHERE len(w) >= size) t),
hit AS (SELECT p.doc_id, p.s, p.size, i.item_id FROM place p JOIN piece i ON p.gram = i.gram AND p.size = i.size),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) t GROUP BY doc_id),
words AS (
  SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(range(s, s + size)) AS at FROM (SELECT DISTINCT doc_id, s, size FROM hit) u) t
  GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(x.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(x.n_hit, 0) > 0 AND 20 * coalesce(x.n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN words x ON d.doc_id = x.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""


NEAR_DEDUP = f"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM doc WHERE len(w) > 0) t),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingle a JOIN shingle b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT a, b FROM both_ JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM doc
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN link l ON r.other = l.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM doc d LEFT JOIN size s ON d.doc_id = s.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""


def license_sql() -> str:
    rows = [
        f"({k}, '{label}', ARRAY[{', '.join(repr(w) for w in words)}])" for k, label, words in template_words(TEMPLATES)
    ]
    return f"""
WITH t(template, label, words) AS (VALUES {', '.join(rows)}),
doc AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents),
place AS (
  SELECT doc_id, s - 1 AS start,
         CASE WHEN w[s] = 'cc' AND w[s + 1] = 'by' THEN 'cc-by'
              WHEN w[s] = 'general' AND w[s + 1] = 'public' AND w[s + 2] = 'license' THEN 'gpl'
              WHEN w[s] = 'all' AND w[s + 1] = 'rights' AND w[s + 2] = 'reserved' THEN 'reserved' END AS label
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM doc) u WHERE w[s] IN ('cc', 'general', 'all')),
line AS (
  SELECT doc_id, list_distinct({ALNUM_WORDS}) AS words
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents) u),
found AS (
  SELECT doc_id, label, shared / size AS containment FROM (
    SELECT l.doc_id, t.label, len(list_intersect(t.words, l.words)) AS shared, len(t.words) AS size FROM line l, t WHERE len(l.words) > 0) u
  WHERE shared >= ceil({THRESHOLD} * size - 1e-9)),
base AS (
  SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word FROM place WHERE label IS NOT NULL GROUP BY doc_id),
base_label AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels
  FROM (SELECT DISTINCT doc_id, label FROM place WHERE label IS NOT NULL) u GROUP BY doc_id),
every_label AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM place WHERE label IS NOT NULL UNION SELECT doc_id, label FROM found) u GROUP BY doc_id),
best AS (SELECT doc_id, max(containment) AS best FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word,
       coalesce(bl.labels, '') AS base_labels, coalesce(el.labels, '') AS labels,
       CAST(CASE WHEN b.n_base > 0 THEN 1.0 ELSE coalesce(x.best, 0.0) END AS DOUBLE) AS score
FROM doc d LEFT JOIN base b ON d.doc_id = b.doc_id LEFT JOIN base_label bl ON d.doc_id = bl.doc_id
LEFT JOIN every_label el ON d.doc_id = el.doc_id LEFT JOIN best x ON d.doc_id = x.doc_id
"""


# crc32 by bits: the polynomial is the fixed value of zlib's checksum
CRC32 = (
    "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT), lambda crc, b:"
    " list_reduce([xor(crc, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"
)


def _edit(cost: str, letter: str, line: str | None, after: str) -> str:
    """A repair that begins with one more edit: cost, letters and lines; structs compare in that order."""
    lines = f"{after}.lines" if line is None else f"[{line}] || {after}.lines"
    return f"{{'cost': {after}.cost + {cost}, 'audit': '{letter}' || {after}.audit, 'lines': {lines}}}"


def _least(options: list[str]) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _with_inserts(prefix: str) -> str:
    """Four columns before any insert from the same four after it."""
    user, assistant = "'user:'", "'assistant:'"
    to_a = _edit("3", "I", assistant, f"{prefix}3")
    once = [_edit("3", "I", user, f"{prefix}2"), _edit("3", "I", user, f"{prefix}2"), to_a, _edit("3", "I", user, f"{prefix}2")]
    twice = f"{{'cost': {prefix}3.cost + 6, 'audit': 'II' || {prefix}3.audit, 'lines': ['user:', 'assistant:'] || {prefix}3.lines}}"
    own = [[f"{prefix}{s}", once[s], *([twice] if s < 2 else [])] for s in range(4)]
    return ", ".join(f"{_least(options)} AS f{s}" for s, options in enumerate(own))


def _row_edits(state: int) -> str:
    """The best way on through a row from a state; f0 to f3 are what follows it."""
    turn = (2, 2, 3, 2)[state]
    made = "'assistant:' || text" if turn == 3 else "'user:' || text"
    gone = _edit("4", "D", None, f"f{state}")
    rerole = _edit("3 + late", "R", made, f"f{turn}")
    legal = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
    keeps = " ".join(f"WHEN initial = '{c}' THEN " + _least([gone, rerole, _edit("late", "K", "role || ':' || text", f"f{to}")]) for c, to in legal.items())
    return f"CASE WHEN must_go THEN {gone} {keeps} ELSE {_least([gone, rerole])} END AS h{state}"


_NOTHING = "{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}"
_DEAD = "{'cost': 1000000000000::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}"
_TRIMMED = r"regexp_replace(text, '[\x20\x09-\x0D]+$', '')"

# The best repair of the rows from each one on, for the four states of the pattern, from the last row to the first.
CONVERSATION_REPAIR = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
hashed AS (SELECT *, {CRC32.format("k")} % 20 AS fault FROM raw),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE fault <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, sha256(text) DESC, copy DESC) AS k,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         {_TRIMMED} AS trimmed, left(role, 1) AS initial FROM damaged),
marked AS (
  SELECT *, trimmed = '' AS blank, trimmed <> '' AND again AS duplicate,
         trimmed <> '' AND NOT again AND right(trimmed, 1) NOT IN ('.', '!', '?') AS truncated,
         initial || coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY k), '') AS pair FROM placed),
ids AS (SELECT DISTINCT conv_id FROM conversations),
best AS (
  SELECT CAST(0 AS BIGINT) AS k, conv_id, {_with_inserts("h")}
  FROM (SELECT conv_id, {_NOTHING} AS h0, {_DEAD} AS h1, {_DEAD} AS h2, {_NOTHING} AS h3 FROM ids) e
  UNION ALL
  SELECT k, conv_id, {_with_inserts("h")} FROM (
    SELECT r.k, r.conv_id, {", ".join(_row_edits(s) for s in range(4))}
    FROM best b JOIN (SELECT *, blank OR duplicate AS must_go, CASE WHEN truncated THEN 3 ELSE 0 END AS late FROM marked) r
      ON r.k = b.k + 1 AND r.conv_id IS NOT DISTINCT FROM b.conv_id) t),
counts AS (
  SELECT conv_id, max(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (k > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id)
SELECT i.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(c.blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(c.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(c.truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(c.illegal, 0) AS BIGINT) AS illegal, b.f0.cost AS cost, b.f0.audit AS audit,
       sha256(array_to_string(b.f0.lines, chr(10))) AS repaired_sha256
FROM ids i LEFT JOIN counts c ON i.conv_id IS NOT DISTINCT FROM c.conv_id
JOIN best b ON i.conv_id IS NOT DISTINCT FROM b.conv_id AND b.k = coalesce(c.n, 0)
"""

RANKED_SEARCH = f"""
WITH term AS (
  SELECT row_no, doc_id, unnest({ALNUM_WORDS}) AS term
  FROM (SELECT row_number() OVER () AS row_no, doc_id, text FROM documents) d),
size AS (SELECT row_no, doc_id, count(*) AS n FROM term GROUP BY ALL),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM size),
query AS (
  SELECT query_no, item_id, term, count(*) AS repeats
  FROM (SELECT query_no, item_id, unnest({ALNUM_WORDS}) AS term
        FROM (SELECT row_number() OVER () AS query_no, item_id, text FROM benchmark) b) t GROUP BY ALL),
tf AS (SELECT row_no, term, count(*) AS tf FROM term WHERE term IN (SELECT term FROM query) GROUP BY ALL),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, docs),
scored AS (
  SELECT q.query_no, q.item_id, s.row_no, s.doc_id,
         sum(q.repeats * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * s.n * t.docs) // t.length)))) AS score
  FROM query q JOIN tf ON q.term = tf.term JOIN weight w ON w.term = tf.term JOIN size s ON s.row_no = tf.row_no, total t GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM placed WHERE rank <= 20
"""

ORACLES: dict[str, str] = {
    "op2_substring_dedup": SUBSTRING_DEDUP,
    "op4_license_scan": license_sql(),
    "op5_exact_dedup": EXACT_DEDUP,
    "op6_decontamination": DECONTAMINATION,
    "op7_near_dedup": NEAR_DEDUP,
    "op11_conversation_repair": CONVERSATION_REPAIR,
    "op13_ranked_search": RANKED_SEARCH,
}
