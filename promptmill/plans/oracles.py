"""The same results in plain SQL, for a second engine: query name -> statement.

Each statement is built from common table expressions over the given tables. They follow the
definitions of the operators, not their plans.
"""

from __future__ import annotations

# Fixed values, written out here so that a wrong one in the package is seen: tasks, sizes, seeds, ids.
NO_YES, LEVELS, SENTIMENTS = ("No", "Yes"), ("normal", "offensive", "hatespeech"), ("negative", "neutral", "positive")
GROUP, ABUSE, HATE, IT_WAS = "offensive towards a group ?", "Verbal abuse directed at a group ?", "Hate speech?", "It was"
TASKS = [
    # task, text column, question, sentiment prompt, label words
    ("sbic", "post", GROUP, False, NO_YES),
    ("sbic_v2", "post", GROUP, True, NO_YES),
    ("sbic_v2_prompt_v2", "post", ABUSE, True, NO_YES),
    ("sbic_v2_prompt_v3", "post", HATE, True, NO_YES),
    ("hatexplain_two", "text_joined", GROUP, True, NO_YES),
    ("hatexplain_thr", "text_joined", GROUP, False, LEVELS),
    ("hatexplain_thr_v2", "text_joined", GROUP, True, LEVELS),
    ("hs18", "text", GROUP, True, NO_YES),
    ("ethos", "comment", GROUP, True, NO_YES),
    ("toxigen", "text", GROUP, True, NO_YES),
    ("t4sa", "text", IT_WAS, False, SENTIMENTS),
    ("t4sa_sbic", "post", IT_WAS, False, SENTIMENTS),
    ("t4sa_hatexplaintwo", "text_joined", IT_WAS, False, SENTIMENTS),
    ("t4sa_hatexplainthr", "text_joined", IT_WAS, False, SENTIMENTS),
    ("t4sa_hs18", "text", IT_WAS, False, SENTIMENTS),
    ("t4sa_ethos", "comment", IT_WAS, False, SENTIMENTS),
    ("t4sa_toxigen", "text", IT_WAS, False, SENTIMENTS),
]
SIZES = [16, 32, 64, 128, 256, 512, 1024]
SEEDS = [9, 99, 999, 9999, 11, 264, 8758, 5437, 4676, 2364]
START_SCORE = -1.0
VOCAB_SIZE, RESERVED_IDS, SENTIMENT_IDS = 30522, 64, 6
SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]
MAX_LEN, SHORT_LEN, BATCH, TRAIN_BATCH, EPOCHS, WARMUP, PATIENCE, EVAL_EVERY = 512, 16, 32, 16, 10, 0.05, 5, 10
SHOTS, SEED = 128, 9
LABEL_WORDS = (3, 5, 7)
SUBWORDS = 4000
BUCKETS, LOGISTIC_STEPS, LOGISTIC_RATE = 4096, 12, 4.0


def pattern(question: str, sentiment: bool) -> list[str]:
    return ["[text_a]", *(["[sentiment_prompt]"] if sentiment else []), question, "[mask]", "."]


PATTERNS = []
for _task in TASKS:
    if pattern(_task[2], _task[3]) not in PATTERNS:
        PATTERNS.append(pattern(_task[2], _task[3]))

TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')"


def tokens(text: str) -> str:
    return TOKENS.format(text)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def rnd(value: str, digits: int = 6) -> str:
    return f"CASE WHEN round({value}, {digits}) = 0 THEN 0::DOUBLE ELSE round({value}, {digits}) END"


def words(array: str) -> str:
    return f"array_to_string({array}, ' ')"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(r) + ")" for r in rows)


EXAMPLES = """examples AS (
    SELECT d.doc_id AS guid, d.text AS text_a, l.toxic AS label,
           CASE WHEN l.quality = 0 THEN 0 WHEN d.lang = 'en' THEN 2 ELSE 1 END AS senti_gold,
           CASE WHEN d.doc_id % 10 < 8 THEN 'train' WHEN d.doc_id % 10 = 8 THEN 'dev' ELSE 'test' END AS split
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

EXAMPLE_TOKENS = f"""ex AS (
    SELECT guid, label, senti_gold, split, {tokens("text_a")} AS tokens FROM examples)"""

TASK_ROWS = "tasks AS (SELECT * FROM (VALUES " + values(
    [
        (
            str(i),
            text(task),
            text(column),
            str(sentiment).lower(),
            texts(pattern(question, sentiment)),
            "[" + ", ".join(map(str, range(len(verbalizers)))) + "]",
            texts(verbalizers),
        )
        for i, (task, column, question, sentiment, verbalizers) in enumerate(TASKS)
    ]
) + ") t(task_no, task, text_column, reads_sentiment, pattern, labels, verbalizers))"

TASK_EXAMPLES = """task_examples AS (
    SELECT e.guid, e.text_a, e.label, e.senti_gold AS senti_pre, t.*
    FROM examples e JOIN tasks t ON t.task_no = e.guid % 17)"""

VECTOR_LOGITS = """xs AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v,
                  generate_subscripts(embedding, 1) AS i FROM embeddings),
    means AS (SELECT label AS class, i, avg(v) AS m FROM xs GROUP BY ALL),
    logits10 AS (SELECT xs.vec_id AS guid, xs.label, means.class, sum(xs.v * means.m) AS logit
                 FROM xs JOIN means ON xs.i = means.i GROUP BY ALL)"""

EVEN_LOGITS = VECTOR_LOGITS.replace("sum(xs.v * means.m) AS logit", "round(sum(xs.v * means.m), 6) AS logit")

VECTOR_PREDICTIONS = """preds AS (
    SELECT guid, label, class AS pred FROM logits10
    QUALIFY row_number() OVER (PARTITION BY guid ORDER BY logit DESC, class) = 1)"""

SOFTMAX = """shifted AS (
    SELECT guid, label, class, exp(logit - max(logit) OVER (PARTITION BY guid)) AS e FROM logits10),
    probs AS (SELECT guid, label, class, e / sum(e) OVER (PARTITION BY guid) AS prob FROM shifted)"""

AUROC_PAIRS = """pairs AS (
    SELECT p.class, o.label AS other,
           sum(CASE WHEN p.prob > o.prob THEN 1.0::DOUBLE WHEN p.prob = o.prob THEN 0.5::DOUBLE ELSE 0::DOUBLE END)
           / count(*) AS auc
    FROM probs p JOIN probs o ON o.class = p.class AND o.label <> p.class
    WHERE p.label = p.class GROUP BY ALL)"""

HISTORY = """history AS (
    SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value,
           json_extract_string(props, '$.k')::DOUBLE / 100 AS test_value FROM events)"""

IMPROVED = f"""judged AS (
    SELECT run, step, value, test_value,
           greatest(coalesce(max(value) OVER (PARTITION BY run ORDER BY step
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {START_SCORE}), {START_SCORE})::DOUBLE AS best_before,
           (value > best_before)::INTEGER AS improved FROM history)"""

SAMPLE = f"""sample AS (
    SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY md5(concat_ws('-', seed, guid)), guid)::INTEGER AS rank,
           guid, label
    FROM examples, (SELECT unnest([{", ".join(map(str, SEEDS))}]) AS seed) WHERE split = 'train'
    QUALIFY rank <= {SIZES[-1]})"""

CELLS = f"""sizes AS (SELECT unnest([{", ".join(map(str, SIZES))}]) AS n),
    cells AS (SELECT n, seed, count(*) AS n_rows FROM sample JOIN sizes ON rank <= n GROUP BY ALL)"""

PROMPT_PHRASES = "phrases AS (SELECT * FROM (VALUES " + values(
    [
        row
        for task, _, question, sentiment, verbalizers in TASKS
        for row in (
            [(text(task), "0", str(i), text(p)) for i, p in enumerate(pattern(question, sentiment)) if p[0] != "["]
            + [(text(task), "1", str(i), text(v)) for i, v in enumerate(verbalizers)]
            + [(text(task), "2", str(i), text(p)) for i, p in enumerate((IT_WAS, "."))]
            + [(text(task), "3", str(i), text(s)) for i, s in enumerate(SENTIMENTS)]
        )
    ]
) + ") p(task, section, pos, phrase))"

VOCAB = f"""phrase_tokens AS (
        SELECT task, section, pos, unnest({tokens("phrase")}) AS token,
               generate_subscripts({tokens("phrase")}, 1) AS tok_pos FROM phrases),
    prompt_words AS (SELECT DISTINCT token FROM phrase_tokens),
    corpus_tokens AS (
        SELECT token, count(*) AS n FROM (SELECT unnest({tokens("text")}) AS token FROM documents)
        WHERE token NOT IN (SELECT token FROM prompt_words) GROUP BY token),
    ranked AS (
        SELECT 0 AS part, unnest({texts(SPECIAL_TOKENS)}) AS token,
               generate_subscripts({texts(SPECIAL_TOKENS)}, 1) AS place, 0 AS n
        UNION ALL SELECT 1, token, 0, 0 FROM prompt_words
        UNION ALL SELECT 2, token, 0, n FROM corpus_tokens),
    vocab AS (
        SELECT token, (row_number() OVER (ORDER BY part, place, n DESC, token) - 1)::INTEGER AS id, n::BIGINT AS n
        FROM ranked QUALIFY id < {VOCAB_SIZE - RESERVED_IDS}),
    prompt_ids AS (
        SELECT task, section, pos, tok_pos, p.token, coalesce(v.id, 1) AS id
        FROM phrase_tokens p LEFT JOIN vocab v ON p.token = v.token)"""


def reserved(name: str, size: str, first: int) -> str:
    return f"""{name} AS (
        SELECT task, CASE WHEN section = 0 THEN 'pattern' ELSE 'label' END AS kind, token, id AS old_id, pos,
               row_number() OVER w AS ord, ({size} - {first} - row_number() OVER w)::INTEGER AS new_id
        FROM prompt_ids WHERE section = 0 OR (section = 1 AND tok_pos = 1)
        WINDOW w AS (PARTITION BY task ORDER BY section, pos, tok_pos))"""


def encoded(max_len: int) -> str:
    """Slots per example, lengths kept by the level rule, then ids and flags per position."""
    return f"""occ AS (
        SELECT guid, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS p
        FROM (SELECT guid, {tokens("text_a")} AS tokens FROM task_examples)),
    text_ids AS (
        SELECT o.guid, list(coalesce(v.id, 1) ORDER BY o.p) AS ids
        FROM occ o LEFT JOIN vocab v ON o.token = v.token GROUP BY o.guid),
    frame AS (
        SELECT task, list(id ORDER BY pos, tok_pos) FILTER (section = 2 AND pos = 0) AS opening,
               list(id ORDER BY pos, tok_pos) FILTER (section = 2 AND pos = 1) AS closing
        FROM prompt_ids GROUP BY task),
    phrase_ids AS (SELECT task, section, pos, list(id ORDER BY tok_pos) AS ids FROM prompt_ids GROUP BY ALL),
    slots AS (
        SELECT e.guid, e.task, e.label, e.senti_pre, unnest(e.pattern) AS slot,
               generate_subscripts(e.pattern, 1) - 1 AS slot_no FROM task_examples e),
    parts AS (
        SELECT s.*, CASE WHEN slot = '[text_a]' THEN coalesce(t.ids, []::INTEGER[])
                 WHEN slot = '[mask]' THEN [4]
                 WHEN slot = '[sentiment_prompt]' THEN f.opening || w.ids || f.closing
                 ELSE l.ids END AS ids
        FROM slots s JOIN frame f ON f.task = s.task LEFT JOIN text_ids t ON t.guid = s.guid
        LEFT JOIN phrase_ids w ON w.task = s.task AND w.section = 3 AND w.pos = s.senti_pre
        LEFT JOIN phrase_ids l ON l.task = s.task AND l.section = 0 AND l.pos = s.slot_no),
    sizes_of AS (
        SELECT guid, list(len(ids) ORDER BY slot_no) AS ls, {max_len - 4} AS b FROM parts GROUP BY guid),
    levels AS (
        SELECT guid, ls, b, list_max(list_filter(range(0, least(list_max(ls), b) + 1),
               lambda x: list_sum(list_transform(ls, lambda v: least(v, x))) <= b)) AS lv FROM sizes_of),
    spare AS (
        SELECT guid, ls, b, lv, b - list_sum(list_transform(ls, lambda v: least(v, lv))) AS r,
               len(list_filter(ls, lambda v: v > lv)) AS nb FROM levels),
    cut AS (
        SELECT p.*, s.ls, CASE WHEN list_sum(s.ls) <= s.b THEN len(p.ids)
               ELSE least(len(p.ids), s.lv) + CASE WHEN len(p.ids) > s.lv AND
                 sum((len(p.ids) > s.lv)::INTEGER) OVER (PARTITION BY p.guid ORDER BY p.slot_no) > s.nb - s.r
                 THEN 1 ELSE 0 END END AS kept
        FROM parts p JOIN spare s ON s.guid = p.guid),
    pieces AS (
        SELECT *, CASE WHEN slot = '[mask]' THEN ids ELSE ids[1:kept] END AS body,
               slot IN ('[text_a]', '[sentiment_prompt]') AS closes,
               CASE WHEN slot = '[text_a]' THEN 0 WHEN slot = '[mask]' THEN -1
                    WHEN slot = '[sentiment_prompt]' THEN 3 ELSE 2 END AS flag FROM cut),
    assembled AS (
        SELECT guid, task, label, senti_pre,
               [2] || flatten(list(body || CASE WHEN closes THEN [3] ELSE []::INTEGER[] END ORDER BY slot_no)) || [3] AS ids,
               [1] || flatten(list(list_transform(body, lambda x: flag)
                      || CASE WHEN closes THEN [1] ELSE []::INTEGER[] END ORDER BY slot_no)) || [1] AS flags,
               (1 + sum(CASE WHEN slot_no <= last_close THEN len(body) + closes::INTEGER ELSE 0 END))::INTEGER AS seg
        FROM (SELECT *, max(CASE WHEN closes THEN slot_no END) OVER (PARTITION BY guid) AS last_close FROM pieces)
        GROUP BY guid, task, label, senti_pre),
    encoded AS (
        SELECT a.*, w.ids[1] AS pet_label FROM assembled a
        JOIN phrase_ids w ON w.task = a.task AND w.section = 1 AND w.pos = a.label)"""


def padded(max_len: int) -> str:
    return f"""padded AS (
        SELECT guid, task, label, senti_pre,
               ids || list_resize([]::INTEGER[], {max_len} - len(ids), 0) AS ids,
               list_resize(list_resize([]::INTEGER[], len(ids), 1), {max_len}, 0) AS mask,
               list_resize(list_resize(list_resize([]::INTEGER[], seg, 0), len(ids), 1), {max_len}, 0) AS types,
               list_resize(flags, {max_len}, 1) AS flags FROM encoded)"""


ENCODE_BASE = [EXAMPLES, TASK_ROWS, TASK_EXAMPLES, PROMPT_PHRASES, VOCAB]


def trained(name: str, rows: str, label: str, classes: int) -> str:
    """Token weights and priors of a single model from rows of tokens."""
    return f"""{name}_count AS (
        SELECT {label} AS class, token, count(*) AS n
        FROM (SELECT {label}, unnest(tokens) AS token FROM {rows}) GROUP BY ALL),
    {name}_voc AS (SELECT DISTINCT token FROM {name}_count),
    {name}_all AS (
        SELECT k.class, coalesce(sum(n), 0) AS total
        FROM (SELECT unnest(range({classes})) AS class) k LEFT JOIN {name}_count c ON c.class = k.class GROUP BY ALL),
    {name}_weight AS (
        SELECT a.class, v.token, coalesce(c.n, 0) AS n,
               round(ln((coalesce(c.n, 0) + 1)::DOUBLE / (a.total + (SELECT count(*) FROM {name}_voc))) * 1e9)::BIGINT AS w
        FROM {name}_voc v CROSS JOIN {name}_all a LEFT JOIN {name}_count c ON c.class = a.class AND c.token = v.token),
    {name}_prior AS (
        SELECT k.class, round(ln((count(r.guid) + 1)::DOUBLE / ((SELECT count(*) FROM {rows}) + {classes})) * 1e9)::BIGINT AS p
        FROM (SELECT unnest(range({classes})) AS class) k LEFT JOIN {rows} r ON r.{label} = k.class GROUP BY ALL)"""


def scored(name: str, model: str, rows: str, key: str = "guid") -> str:
    """Logits in whole units per row and class, and the winning class."""
    return f"""{name}_tf AS (
        SELECT {key}, token, count(*) AS tf FROM (SELECT {key}, unnest(tokens) AS token FROM {rows}) GROUP BY ALL),
    {name}_sum AS (SELECT {key}, class, sum(tf * w) AS s FROM {name}_tf JOIN {model}_weight USING (token) GROUP BY ALL),
    {name}_units AS (
        SELECT r.{key}, p.class, (p.p + coalesce(s.s, 0))::BIGINT AS units
        FROM {rows} r CROSS JOIN {model}_prior p LEFT JOIN {name}_sum s ON s.{key} = r.{key} AND s.class = p.class),
    {name}_pred AS (
        SELECT {key}, class::INTEGER AS pred FROM {name}_units
        QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY units DESC, class) = 1)"""


def unit_losses(name: str, units: str, rows: str) -> str:
    """Cross-entropy of every row from its logits in whole units."""
    return f"""{name} AS (
        SELECT u.guid, e.label, max(units) / 1e9 + ln(sum(exp((units - top) / 1e9)))
               - max(units) FILTER (class = e.label) / 1e9 AS ce
        FROM (SELECT *, max(units) OVER (PARTITION BY guid) AS top FROM {units}) u
        JOIN {rows} e ON e.guid = u.guid GROUP BY u.guid, e.label)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n    ".join(parts) + "\n"


TRAIN_ROWS = "train_rows AS (SELECT * FROM ex WHERE split = 'train')"
HELD_OUT = "held_out AS (SELECT * FROM ex WHERE split <> 'train')"
TOXIC = [EXAMPLES, EXAMPLE_TOKENS, TRAIN_ROWS, trained("toxic", "train_rows", "label", 2)]
TOXIC_HELD = [*TOXIC, HELD_OUT, scored("held", "toxic", "held_out"),
              "preds AS (SELECT h.*, pred FROM held_out h JOIN held_pred USING (guid))"]
SENTI = [EXAMPLES, EXAMPLE_TOKENS, TRAIN_ROWS, trained("senti", "train_rows", "senti_gold", 3)]
# Pieces of up to 8 letters of all words, the most frequent ones, and the longest one at each place of a word.
SUBWORD_PIECES = (
    "word AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM docs) t GROUP BY token)",
    """cut AS (
      SELECT CASE WHEN a > 1 THEN '##' ELSE '' END || substr(token, a, size) AS piece, n
      FROM (SELECT token, n, a, unnest(range(1, least(8, length(token) - a + 1) + 1)) AS size
            FROM (SELECT token, n, unnest(range(1, length(token) + 1)) AS a FROM word) s) c)""",
    f"known AS (SELECT piece FROM cut GROUP BY piece ORDER BY sum(n) DESC, piece LIMIT {SUBWORDS})",
    """walk AS (
      SELECT token, CAST(1 AS BIGINT) AS a, CAST([] AS VARCHAR[]) AS pieces FROM word
      UNION ALL
      SELECT token, a + size, list_append(pieces, piece) FROM (
        SELECT w.token, w.a, w.pieces, k.piece, s.size, row_number() OVER (PARTITION BY w.token ORDER BY s.size DESC) AS nth
        FROM walk w CROSS JOIN (SELECT unnest(range(1, 9)) AS size) s
        JOIN known k ON k.piece = CASE WHEN w.a > 1 THEN '##' ELSE '' END || substr(w.token, w.a, s.size)
        WHERE w.a + s.size <= length(w.token) + 1) f WHERE nth = 1)""",
    """split AS (
      SELECT w.token, coalesce(max(pieces) FILTER (a = length(w.token) + 1), ['[UNK]']) AS pieces
      FROM word w JOIN walk USING (token) GROUP BY w.token)""",
    """placed AS (
      SELECT guid, i, token FROM (SELECT guid, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM docs) t)""",
    """joined AS (
      SELECT d.guid, coalesce(p.pieces, []) AS pieces FROM docs d
      LEFT JOIN (SELECT guid, flatten(list(pieces ORDER BY i)) AS pieces FROM placed JOIN split USING (token) GROUP BY guid) p ON p.guid = d.guid)""",
)
DOCUMENT_TOKENS = f"docs AS (SELECT doc_id AS guid, {tokens('text')} AS tokens FROM documents)"
SENTI_DOCUMENTS = [*SENTI, DOCUMENT_TOKENS, scored("doc", "senti", "docs")]
# Examples whose tokens end with the token of their predicted sentiment.
SENTI_EXAMPLES = [
    *SENTI,
    scored("ex", "senti", "ex"),
    """annotated AS (
        SELECT guid, label, split, pred AS senti_pre, list_append(tokens, '<senti:' || pred || '>') AS tokens
        FROM ex JOIN ex_pred USING (guid))""",
]
STAGE3 = [
    *SENTI_EXAMPLES,
    SAMPLE,
    f"""shots AS (SELECT a.* FROM annotated a JOIN sample s ON s.guid = a.guid
                  WHERE s.seed = {SEED} AND s.rank <= {SHOTS})""",
    trained("few", "shots", "label", 2),
    "held_out AS (SELECT * FROM annotated WHERE split <> 'train')",
    scored("held", "few", "held_out"),
    "preds AS (SELECT h.*, pred FROM held_out h JOIN held_pred USING (guid))",
]


def binary(source: str, by: str = "", extra: str = "") -> str:
    """precision, accuracy, f1_score of class 1."""
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    precision = "coalesce(count(*) FILTER (label = 1 AND pred = 1) / nullif(count(*) FILTER (pred = 1), 0), 0)"
    accuracy = "count(*) FILTER (label = pred) / count(*)"
    f1 = (
        "coalesce(2 * count(*) FILTER (label = 1 AND pred = 1)"
        " / nullif(count(*) FILTER (pred = 1) + count(*) FILTER (label = 1), 0), 0)"
    )
    return (
        f"SELECT {keys}count(*) AS n_rows, {rnd(precision)} AS precision, {rnd(accuracy)} AS accuracy,"
        f" {rnd(f1)} AS f1_score FROM {source}{group}"
    )


def macro(source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    per_class = f"""found AS (SELECT DISTINCT {keys}label AS class FROM {source} UNION SELECT DISTINCT {keys}pred FROM {source}),
    f1s AS (SELECT {("f." + by + ", ") if by else ""}f.class,
                   2 * count(*) FILTER (p.label = f.class AND p.pred = f.class)
                   / (count(*) FILTER (p.label = f.class) + count(*) FILTER (p.pred = f.class)) AS f1
            FROM found f JOIN {source} p ON {f"p.{by} = f.{by}" if by else "true"} GROUP BY ALL)"""
    on = f"WHERE f1s.{by} = p.{by}" if by else ""
    body = (
        f"SELECT {keys}count(*) AS n_rows, {rnd('count(*) FILTER (label = pred) / count(*)')} AS accuracy,"
        f" {rnd(f'(SELECT avg(f1) FROM f1s {on})')} AS f1_score FROM {source} p"
        + (f" GROUP BY {by}" if by else "")
    )
    return per_class, body


def batches(name: str, rows: str, size: int, columns: str = "*") -> str:
    return f"""{name} AS (
        SELECT {columns}, ((row_number() OVER (ORDER BY guid) - 1) // {size})::BIGINT AS batch_id,
               ((row_number() OVER (ORDER BY guid) - 1) % {size})::INTEGER AS pos FROM {rows})"""


CE_FULL = """ce_full AS (
    SELECT guid, label, max(logit) + ln(sum(exp(logit - top))) - max(logit) FILTER (class = label) AS ce
    FROM (SELECT *, max(logit) OVER (PARTITION BY guid) AS top FROM logits10) GROUP BY guid, label)"""

BATCH_LOSS = """batch_loss AS (SELECT batch_id, avg(ce) AS loss, count(*) AS n_rows FROM batched GROUP BY batch_id)"""

VECTOR_REMAP = [PROMPT_PHRASES, VOCAB, reserved("remap", "(SELECT count(*) FROM embeddings)", 0)]

WORDS_3 = ", ".join(map(str, LABEL_WORDS))


def corpus_family(reads_sentiment: bool) -> str:
    senti = "senti_gold" if reads_sentiment else "NULL::INTEGER"
    return (
        with_(EXAMPLES)
        + f"""SELECT guid, text_a, NULL::VARCHAR AS text_b, label, -1 AS idx, {senti} AS senti_pre, 0 AS n_meta FROM examples"""
    )


def remapped(first: int, sentiment: bool) -> str:
    """Ids with the n-th flagged position replaced by the n-th new id."""
    senti = f"""CASE WHEN flag = 3 THEN CASE nth WHEN 1 THEN {VOCAB_SIZE - 1} WHEN 2 THEN {VOCAB_SIZE - 2}
                     WHEN 4 THEN {VOCAB_SIZE - 3} ELSE {VOCAB_SIZE - 4} - senti_pre END"""
    value = "CASE WHEN flag = 2 THEN coalesce(r.new_id, x.id) ELSE x.id END"
    if sentiment:
        value = f"{senti} WHEN flag = 2 THEN coalesce(r.new_id, x.id) ELSE x.id END"
    only = "WHERE list_contains(e.flags, 3)" if sentiment else ""
    return (
        with_(
            *ENCODE_BASE,
            encoded(MAX_LEN),
            reserved("reserved", str(VOCAB_SIZE), first),
            f"""placed AS (
                SELECT *, row_number() OVER (PARTITION BY guid, flag ORDER BY p) AS nth FROM (
                SELECT guid, task, label, senti_pre, unnest(ids) AS id, unnest(flags) AS flag,
                       generate_subscripts(ids, 1) AS p FROM encoded e {only}))""",
            f"""swapped AS (
                SELECT x.guid, x.task, x.label, x.p, {value} AS id FROM placed x
                LEFT JOIN reserved r ON r.task = x.task AND r.kind = 'pattern' AND r.ord = x.nth)""",
            f"labels_new AS (SELECT task, pos, new_id FROM reserved WHERE kind = 'label')",
        )
        + f"""SELECT s.guid, s.task, {words("list(s.id ORDER BY s.p)")} AS input_ids, l.new_id AS pet_label
          FROM swapped s JOIN labels_new l ON l.task = s.task AND l.pos = s.label GROUP BY s.guid, s.task, l.new_id"""
    )


KEYS = "keys AS (SELECT DISTINCT k, n, seed, split FROM preds)"


def sweep_units(classes: int) -> list[str]:
    """units (k, n, seed, split, guid, label, class, units) and preds of all runs; k names a run and split."""
    return [
        SAMPLE,
        f"sizes AS (SELECT unnest([{', '.join(map(str, SIZES))}]) AS n)",
        """members AS (SELECT n, seed, a.guid, a.label AS class, a.tokens
            FROM sample s JOIN sizes ON s.rank <= n JOIN annotated a ON a.guid = s.guid)""",
        """counts AS (SELECT n, seed, class, token, count(*) AS c
            FROM (SELECT n, seed, class, unnest(tokens) AS token FROM members) GROUP BY ALL)""",
        "voc AS (SELECT DISTINCT n, seed, token FROM counts)",
        "voc_size AS (SELECT n, seed, count(*) AS v FROM voc GROUP BY ALL)",
        f"classes AS (SELECT unnest(range({classes})) AS class)",
        """totals AS (SELECT v.n, v.seed, k.class, v.v, coalesce(sum(c), 0) AS total FROM voc_size v CROSS JOIN classes k
            LEFT JOIN counts c ON c.n = v.n AND c.seed = v.seed AND c.class = k.class GROUP BY ALL)""",
        """weights AS (SELECT v.n, v.seed, v.token, t.class,
            round(ln((coalesce(c.c, 0) + 1)::DOUBLE / (t.total + t.v)) * 1e9)::BIGINT AS w
            FROM voc v JOIN totals t ON t.n = v.n AND t.seed = v.seed
            LEFT JOIN counts c ON c.n = v.n AND c.seed = v.seed AND c.class = t.class AND c.token = v.token)""",
        "run_docs AS (SELECT n, seed, count(*) AS docs FROM members GROUP BY ALL)",
        "class_docs AS (SELECT n, seed, class, count(*) AS own FROM members GROUP BY ALL)",
        f"""priors AS (SELECT r.n, r.seed, k.class,
            round(ln((coalesce(o.own, 0) + 1)::DOUBLE / (r.docs + {classes})) * 1e9)::BIGINT AS p
            FROM run_docs r CROSS JOIN classes k LEFT JOIN class_docs o ON o.n = r.n AND o.seed = r.seed AND o.class = k.class)""",
        "held_out AS (SELECT * FROM annotated WHERE split <> 'train')",
        """tf AS (SELECT guid, token, count(*) AS tf
            FROM (SELECT guid, unnest(tokens) AS token FROM held_out) GROUP BY ALL)""",
        "sums AS (SELECT guid, n, seed, class, sum(tf * w) AS s FROM tf JOIN weights USING (token) GROUP BY ALL)",
        """units AS (SELECT h.guid, h.split, h.label, p.n, p.seed, p.class, p.p + coalesce(s.s, 0) AS units,
                p.n || '-' || p.seed || '-' || h.split AS k
            FROM held_out h CROSS JOIN priors p
            LEFT JOIN sums s ON s.guid = h.guid AND s.n = p.n AND s.seed = p.seed AND s.class = p.class)""",
        """preds AS (SELECT k, n, seed, split, guid, label, class AS pred FROM units
            QUALIFY row_number() OVER (PARTITION BY k, guid ORDER BY units DESC, class) = 1)""",
    ]


def judged_by_key(classes: int, multiclass: bool = True) -> list[str]:
    """loss_by, and for several classes macro_by and auroc_by: one row for each k of units and preds."""
    parts = [
        """ces AS (SELECT k, guid, split, max(units) / 1e9 + ln(sum(exp((units - top) / 1e9)))
               - max(units) FILTER (class = label) / 1e9 AS ce
            FROM (SELECT *, max(units) OVER (PARTITION BY k, guid) AS top FROM units) u GROUP BY k, guid, split)""",
        f"""ce_batches AS (SELECT k, guid, ce, (row_number() OVER (PARTITION BY k ORDER BY guid) - 1) // {TRAIN_BATCH} AS batch_id
            FROM ces)""",
        f"""loss_by AS (SELECT k, {rnd("sum(loss)")} AS loss
            FROM (SELECT k, batch_id, avg(ce) AS loss FROM ce_batches GROUP BY k, batch_id) GROUP BY k)""",
    ]
    if not multiclass:
        return parts
    found, body = macro("preds", "k")
    return parts + [
        found,
        f"macro_by AS ({body})",
        """run_probs AS (SELECT k, guid, label, class, e / sum(e) OVER (PARTITION BY k, guid) AS prob FROM (
            SELECT k, guid, label, class, exp((units - max(units) OVER (PARTITION BY k, guid)) / 1e9) AS e FROM units))""",
        """run_pairs AS (SELECT p.k, p.class, o.label AS other,
               sum(CASE WHEN p.prob > o.prob THEN 1.0::DOUBLE WHEN p.prob = o.prob THEN 0.5::DOUBLE ELSE 0::DOUBLE END)
               / count(*) AS auc
            FROM run_probs p JOIN run_probs o ON o.k = p.k AND o.class = p.class AND o.label <> p.class
            WHERE p.label = p.class GROUP BY ALL)""",
        f"""auroc_by AS (SELECT x.k, CASE WHEN count(auc) = {classes * (classes - 1)} THEN {rnd("avg(auc)")} END AS AUROC_score,
               ({classes * (classes - 1)} - count(auc))::BIGINT AS undefined_pairs
            FROM (SELECT DISTINCT k FROM preds) x LEFT JOIN run_pairs r ON r.k = x.k GROUP BY x.k)""",
    ]


def own_task() -> str:
    """A task with two texts: ids of both, cut from the longer part down, as one list per row."""
    phrase = f"""own_words AS (SELECT list(coalesce(v.id, 1) ORDER BY i) AS ids FROM (
            SELECT unnest({tokens("'Same tone ?'")}) AS token, generate_subscripts({tokens("'Same tone ?'")}, 1) AS i) t
            LEFT JOIN vocab v ON v.token = t.token),
    stop AS (SELECT list(coalesce(v.id, 1)) AS ids FROM (SELECT '.' AS token) t LEFT JOIN vocab v ON v.token = t.token)"""
    rows = f"""word_rows AS (
        SELECT guid, 0 AS part, unnest({tokens("text_a")}) AS token, generate_subscripts({tokens("text_a")}, 1) AS i FROM examples
        UNION ALL
        SELECT guid, 1, unnest({tokens("second")}), generate_subscripts({tokens("second")}, 1)
        FROM (SELECT guid, 'split ' || split AS second FROM examples)),
    ids_of AS (SELECT guid, part, list(coalesce(v.id, 1) ORDER BY i) AS ids
        FROM word_rows w LEFT JOIN vocab v ON v.token = w.token GROUP BY guid, part),
    both_ids AS (
        SELECT e.guid, e.label, coalesce(a.ids, []::INTEGER[]) AS a, b.ids AS b, o.ids AS o, s.ids AS s,
               {MAX_LEN - 5} - len(b.ids) - len(o.ids) - 1 - len(s.ids) AS room
        FROM examples e LEFT JOIN ids_of a ON a.guid = e.guid AND a.part = 0 JOIN ids_of b ON b.guid = e.guid AND b.part = 1,
             own_words o, stop s)"""
    return (
        with_(EXAMPLES, PROMPT_PHRASES, VOCAB, phrase, rows)
        + f"""SELECT guid, {words("[2] || a[1:room] || [3] || b || o || [4] || s || [3]")} AS input_ids,
              {words("[1] || list_transform(a[1:room], lambda x: 0) || [1] || list_transform(b, lambda x: 0)"
                     " || list_transform(o, lambda x: 2) || [-1] || list_transform(s, lambda x: 2) || [1]")} AS pet_flags,
              (2 + least(len(a), room))::INTEGER AS first_segment,
              (SELECT coalesce(max(id), 1) FROM vocab WHERE token = CASE label WHEN 0 THEN 'no' ELSE 'yes' END) AS pet_label
              FROM both_ids"""
    )


def nearest(value: str) -> str:
    return f"CAST(floor({value} + 0.5) AS BIGINT)"


def logistic() -> list[str]:
    """Gradient steps, one expression after the other: buckets, their values, then weights after each step."""
    steps = [
        f"""found AS MATERIALIZED (SELECT DISTINCT guid, split, label, ('0x' || substr(md5(token), 1, 4))::INTEGER % {BUCKETS} AS bucket
            FROM (SELECT guid, split, label, unnest(tokens) AS token FROM ex))""",
        """learned AS (SELECT count(*) AS total, greatest(count(*) FILTER (label = 1), 1) AS ones,
            greatest(count(*) FILTER (label = 0), 1) AS zeros FROM ex WHERE split = 'train')""",
        """shares AS (SELECT guid, total / (2.0::DOUBLE * CASE WHEN label = 1 THEN ones ELSE zeros END) AS share
            FROM ex CROSS JOIN learned WHERE split = 'train')""",
        f"""held AS MATERIALIZED (SELECT b AS bucket, {nearest("1000.0::DOUBLE * ln((total + 1)::DOUBLE / (coalesce(n, 0) + 1))")} AS log
            FROM range({BUCKETS}) r(b) CROSS JOIN learned
            LEFT JOIN (SELECT bucket, count(*) AS n FROM found WHERE split = 'train' GROUP BY ALL) ON bucket = b)""",
        "lengths AS (SELECT guid, sqrt(greatest(sum(log * log), 1)::DOUBLE) AS length FROM found JOIN held USING (bucket) GROUP BY ALL)",
        f"""xs AS MATERIALIZED (SELECT guid, bucket, {nearest("log * 1000000.0::DOUBLE / length")} AS x
            FROM found JOIN held USING (bucket) JOIN lengths USING (guid)
            UNION ALL SELECT guid, {BUCKETS}, 1000000 FROM ex)""",
        f"w0 AS (SELECT b::INTEGER AS bucket, 0::BIGINT AS weight FROM range({BUCKETS} + 1) r(b))",
    ]
    for i in range(LOGISTIC_STEPS):
        score = "sum(x * weight)::BIGINT / 1000000000000.0::DOUBLE"
        steps += [
            f"""errors{i} AS (SELECT guid, {nearest(f"(1.0::DOUBLE / (exp(-({score})) + 1.0::DOUBLE) - any_value(label)) * any_value(share) * 1000000.0::DOUBLE")} AS error
                FROM xs JOIN w{i} USING (bucket) JOIN ex USING (guid) JOIN shares USING (guid) GROUP BY guid)""",
            f"""pulls{i} AS (SELECT bucket, sum({nearest("(error * x) / 1000000.0::DOUBLE")})::BIGINT AS pull
                FROM xs JOIN errors{i} USING (guid) GROUP BY bucket)""",
            f"""w{i + 1} AS MATERIALIZED (SELECT bucket,
                weight - {nearest(f"({LOGISTIC_RATE}::DOUBLE * coalesce(pull, 0)) / total::DOUBLE")} AS weight
                FROM w{i} CROSS JOIN learned LEFT JOIN pulls{i} USING (bucket))""",
        ]
    return steps


def statements() -> dict[str, str]:
    out: dict[str, str] = {}
    senti_docs = with_(*SENTI_DOCUMENTS)
    out["csv_roundtrip"] = "SELECT doc_id AS guid, text, lang, source, n_chars FROM documents"
    out["csv_split_read"] = (
        """SELECT doc_id AS guid, replace(text, '. ', '.' || chr(10) || chr(10) || '"') AS text, lang FROM documents"""
    )
    out["read_examples_post"] = corpus_family(True)
    out["read_examples_text_joined"] = corpus_family(False)
    out["read_examples_text"] = corpus_family(True)
    out["read_examples_comment"] = corpus_family(False)
    out["task_specs"] = (
        with_(EXAMPLES, TASK_ROWS, TASK_EXAMPLES)
        + f"""SELECT guid, task, text_column, reads_sentiment, array_to_string(pattern, '|') AS pattern,
              {words("labels")} AS labels, array_to_string(verbalizers, '|') AS verbalizers FROM task_examples"""
    )
    out["sweep_partition_read"] = (
        with_(EXAMPLES, SAMPLE) + "SELECT 64 AS n, seed, rank, guid, label FROM sample WHERE seed = 99 AND rank <= 64"
    )
    out["annotate_sink"] = senti_docs + (
        "SELECT doc_id AS guid, text, lang, source, n_chars, pred AS senti_pre"
        " FROM documents JOIN doc_pred ON guid = doc_id"
    )
    out["sink_if_absent"] = (
        with_(EXAMPLES)
        + "SELECT guid, split, senti_gold AS senti_pre, true AS wrote, false AS wrote_again FROM examples WHERE split <> 'train'"
    )
    out["predictions_sink"] = with_(VECTOR_LOGITS, VECTOR_PREDICTIONS) + "SELECT guid, pred FROM preds"
    out["metric_log_long"] = (
        with_(
            *TOXIC,
            scored("ex", "toxic", "ex"),
            "preds AS (SELECT e.guid, split, label, pred FROM ex e JOIN ex_pred USING (guid) WHERE split <> 'train')",
            f"judged AS ({binary('preds', 'split')})",
            unit_losses("ces", "ex_units", "train_rows"),
            batches("batched", "ces", TRAIN_BATCH),
            BATCH_LOSS,
        )
        + f"""SELECT 'toxic' AS run, 0::BIGINT AS step, split, metric, value
          FROM (UNPIVOT judged ON precision, accuracy, f1_score INTO NAME metric VALUE value)
          UNION ALL SELECT 'toxic', batch_id + 1, 'train', 'loss', {rnd("loss")} FROM batch_loss"""
    )
    out["scorer_roundtrip"] = with_(*TOXIC_HELD) + "SELECT guid, split, pred FROM preds"
    out["canonical_examples"] = (
        with_(EXAMPLES)
        + """SELECT guid, text_a, NULL::VARCHAR AS text_b, label, -1 AS idx, NULL::INTEGER AS senti_pre,
             0 AS n_meta, true AS no_logits FROM examples"""
    )
    senti_words = "['negative', 'neutral', 'positive'][senti_gold + 1]"
    patterns = values([(str(i), texts(p)) for i, p in enumerate(PATTERNS)])
    out["prompt_text"] = (
        with_(EXAMPLES)
        + f"""SELECT guid, pattern_no, array_to_string(list_transform(pattern, lambda p:
               CASE WHEN p = '[text_a]' THEN text_a
                    WHEN p = '[sentiment_prompt]' THEN 'It was ' || {senti_words} || ' .' ELSE p END), ' ') AS prompt
              FROM examples, (VALUES {patterns}) t(pattern_no, pattern)"""
    )
    out["sentiment_prompt"] = (
        with_(EXAMPLES)
        + """SELECT guid, CASE senti_gold WHEN 0 THEN 'It was negative .' WHEN 1 THEN 'It was neutral .'
             ELSE 'It was positive .' END AS sentiment_prompt FROM examples"""
    )
    mixed = """mixed AS (
        SELECT *, CASE WHEN guid % 13 = 0 THEN 'null text' WHEN NOT list_contains(labels, senti_pre) THEN 'unknown label'
                  WHEN list_contains(pattern, '[sentiment_prompt]') AND guid % 11 IN (0, 1) THEN 'sentiment out of range'
                  END AS reason FROM task_examples)"""
    out["label_index"] = (
        with_(EXAMPLES, TASK_ROWS, TASK_EXAMPLES, mixed)
        + """SELECT guid, task, senti_pre AS label, (list_position(labels, senti_pre) - 1)::INTEGER AS label_id
             FROM mixed WHERE reason IS NULL"""
    )
    out["label_rejects"] = (
        with_(EXAMPLES, TASK_ROWS, TASK_EXAMPLES, mixed) + "SELECT guid, task, reason FROM mixed WHERE reason IS NOT NULL"
    )
    out["verbalizer_target"] = (
        with_(*ENCODE_BASE)
        + """SELECT e.guid, e.task, e.label AS label_id, verbalizers[e.label + 1] AS word, p.id AS target_id
             FROM task_examples e JOIN prompt_ids p
             ON p.task = e.task AND p.section = 1 AND p.pos = e.label AND p.tok_pos = 1"""
    )
    encode = with_(*ENCODE_BASE, encoded(MAX_LEN))
    out["mask_position"] = encode + (
        "SELECT guid, task, (list_position(flags, -1) - 1)::INTEGER AS mask_pos,"
        " len(list_filter(flags, lambda f: f = -1))::INTEGER AS n_masks FROM encoded"
    )
    out["pattern_literals"] = (
        with_(EXAMPLES, TASK_ROWS, TASK_EXAMPLES)
        + """SELECT task, ord, literal, count(*) AS n_rows FROM (
             SELECT guid, task, unnest(literals) AS literal, (generate_subscripts(literals, 1) - 1)::INTEGER AS ord
             FROM (SELECT guid, task, list_filter(pattern, lambda p: p[1] <> '[') AS literals FROM task_examples))
             GROUP BY ALL"""
    )
    out["eval_steps"] = with_(HISTORY) + f"SELECT run, step, value FROM history WHERE step % {EVAL_EVERY} = 0"
    out["has_sentiment_prompt"] = (
        with_(EXAMPLES, TASK_ROWS, TASK_EXAMPLES)
        + "SELECT task, reads_sentiment AS has_sentiment, count(*) AS n_rows FROM task_examples GROUP BY ALL"
    )
    out["append_predictions"] = senti_docs + (
        "SELECT doc_id AS guid, lang, source, n_chars, pred AS senti_pre FROM documents JOIN doc_pred ON guid = doc_id"
    )
    out["vocab_ids"] = (
        with_(
            PROMPT_PHRASES,
            VOCAB,
            f"occ AS (SELECT doc_id AS guid, unnest({tokens('text')}) AS token,"
            f" generate_subscripts({tokens('text')}, 1) AS p FROM documents)",
        )
        + f"""SELECT d.doc_id AS guid, coalesce(ids, '') AS ids FROM documents d LEFT JOIN (
              SELECT guid, {words("list(coalesce(v.id, 1) ORDER BY p)")} AS ids
              FROM occ o LEFT JOIN vocab v ON v.token = o.token GROUP BY guid) i ON i.guid = d.doc_id"""
    )
    out["id_remap_first"] = remapped(0, False)
    out["id_remap_second"] = remapped(SENTIMENT_IDS, True)
    out["verbalizer_logits"] = (
        with_(VECTOR_LOGITS)
        + f"""SELECT guid, (list_position([{WORDS_3}], class) - 1)::INTEGER AS pos, {rnd("logit")} AS logit
              FROM logits10 WHERE class IN ({WORDS_3})"""
    )
    out["target_ids"] = (
        with_(*ENCODE_BASE, reserved("reserved", str(VOCAB_SIZE), 0))
        + """SELECT e.guid, e.task, e.label AS label_id, r.new_id AS target_id FROM task_examples e
             JOIN reserved r ON r.task = e.task AND r.kind = 'label' AND r.pos = e.label"""
    )
    long_vector = "(generate_subscripts(embedding, 1) - 1)::INTEGER AS i, " + rnd("unnest(embedding)::DOUBLE") + " AS x"
    out["embedding_row_copy"] = (
        with_(*VECTOR_REMAP)
        + f"""SELECT vec_id, i, {rnd("x")} AS x FROM (
              SELECT e.vec_id, (generate_subscripts(e.embedding, 1) - 1)::INTEGER AS i,
                     unnest(coalesce(o.embedding, e.embedding))::DOUBLE AS x
              FROM embeddings e LEFT JOIN remap r ON r.new_id = e.vec_id AND r.task = 'sbic'
              LEFT JOIN embeddings o ON o.vec_id = r.old_id)"""
    )
    out["encode_prompt"] = encode + (
        f"SELECT guid, task, {words('ids')} AS input_ids, {words('flags')} AS pet_flags, seg AS first_segment,"
        " pet_label FROM encoded"
    )
    size_no = f"(list_position([{', '.join(map(str, SIZES))}], n) - 1)"
    seed_no = f"(list_position([{', '.join(map(str, SEEDS))}], seed) - 1)"
    out["sweep_grid"] = (
        with_(EXAMPLES, SAMPLE, CELLS)
        + f"SELECT ({size_no} * {len(SEEDS)} + {seed_no})::INTEGER AS cell, n, seed, n_rows FROM cells"
    )
    out["batch_collate"] = (
        with_(EXAMPLES, batches("batched", "examples", TRAIN_BATCH))
        + f"""SELECT batch_id, {words("list(guid ORDER BY pos)")} AS guids, {words("list(label ORDER BY pos)")} AS labels,
              {words("list(senti_gold ORDER BY pos)")} AS sentis FROM batched GROUP BY batch_id"""
    )
    losses = with_(VECTOR_LOGITS, CE_FULL, batches("batched", "ce_full", BATCH), BATCH_LOSS)
    out["batch_loss"] = losses + f"SELECT batch_id, {rnd('loss')} AS loss, n_rows FROM batch_loss"
    out["eval_loss"] = losses + (
        f"SELECT {rnd('sum(loss)')} AS loss, {rnd('sum(loss * n_rows) / sum(n_rows)')} AS mean_loss FROM batch_loss"
    )
    out["confusion"] = (
        with_(VECTOR_LOGITS, VECTOR_PREDICTIONS) + "SELECT label, pred, count(*) AS n FROM preds GROUP BY ALL"
    )
    out["metrics_binary"] = with_(*TOXIC_HELD) + binary("preds")
    found, body = macro("preds")
    out["metrics_multi"] = with_(VECTOR_LOGITS, VECTOR_PREDICTIONS, found) + body
    out["batch_precision"] = (
        with_(*TOXIC_HELD, batches("batched", "preds", TRAIN_BATCH, "guid, label, pred"), f"m AS ({binary('batched', 'batch_id')})")
        + "SELECT batch_id, n_rows, precision, accuracy AS micro_precision FROM m"
    )
    out["auroc_ovo"] = (
        with_(
            EVEN_LOGITS,
            SOFTMAX,
            AUROC_PAIRS,
        )
        + f"SELECT {rnd('avg(auc)')} AS AUROC_score, (90 - count(*))::BIGINT AS undefined_pairs FROM pairs"
    )
    found, body = macro("preds")
    out["evaluate_task_types"] = (
        with_(
            EVEN_LOGITS,
            VECTOR_PREDICTIONS,
            found,
            f"many AS ({body})",
            SOFTMAX,
            AUROC_PAIRS,
            CE_FULL,
            batches("vector_batches", "ce_full", BATCH),
            "vector_loss AS (SELECT sum(loss) AS loss FROM (SELECT avg(ce) AS loss FROM vector_batches GROUP BY batch_id))",
            *TOXIC,
            "test_rows AS (SELECT * FROM ex WHERE split = 'test')",
            scored("test", "toxic", "test_rows"),
            "test_preds AS (SELECT t.*, pred FROM test_rows t JOIN test_pred USING (guid))",
            f"two AS ({binary('test_preds')})",
            unit_losses("test_ce", "test_units", "test_rows"),
            batches("test_batches", "test_ce", TRAIN_BATCH),
            "test_loss AS (SELECT sum(loss) AS loss FROM (SELECT avg(ce) AS loss FROM test_batches GROUP BY batch_id))",
        )
        + f"""SELECT 'all' AS split, metric, value FROM (UNPIVOT many ON accuracy, f1_score INTO NAME metric VALUE value)
          UNION ALL SELECT 'all', 'AUROC_score', {rnd("avg(auc)")} FROM pairs
          UNION ALL SELECT 'all', 'loss', {rnd("loss")} FROM vector_loss
          UNION ALL SELECT 'test', metric, value
          FROM (UNPIVOT two ON precision, accuracy, f1_score INTO NAME metric VALUE value)
          UNION ALL SELECT 'test', 'loss', {rnd("loss")} FROM test_loss"""
    )
    out["sweep_steps"] = (
        with_(EXAMPLES, SAMPLE, CELLS)
        + f"""SELECT n, seed, (ceil(n_rows / {TRAIN_BATCH}) * {EPOCHS})::BIGINT AS steps,
              floor(ceil(n_rows / {TRAIN_BATCH}) * {EPOCHS} * {WARMUP}::DOUBLE)::BIGINT AS warmup FROM cells"""
    )
    out["part_lengths"] = encode + "SELECT DISTINCT guid, task, list_sum(ls)::INTEGER AS total_length FROM cut"
    out["vector_max_abs"] = (
        f"SELECT vec_id, {rnd('list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))')} AS max_abs FROM embeddings"
    )
    out["vocab_build"] = with_(PROMPT_PHRASES, VOCAB) + "SELECT token, id, n FROM vocab"
    out["train_token_weights"] = (
        with_(*TOXIC) + f"SELECT class::INTEGER AS class, token, n, {rnd('w / 1e9', 4)} AS weight FROM toxic_weight"
    )
    out["subword_pieces"] = with_(DOCUMENT_TOKENS, *SUBWORD_PIECES).replace("WITH ", "WITH RECURSIVE ", 1) + (
        "SELECT guid, CAST(len(pieces) AS INTEGER) AS n_pieces, array_to_string(pieces, ' ') AS pieces FROM joined"
    )
    out["train_logistic"] = with_(EXAMPLES, EXAMPLE_TOKENS, *logistic()) + (
        "SELECT guid, split, label, sum(x * weight)::BIGINT AS score, CAST(sum(x * weight) > 0 AS INTEGER) AS pred"
        f" FROM xs JOIN w{LOGISTIC_STEPS} USING (bucket) JOIN ex USING (guid) WHERE split <> 'train' GROUP BY ALL"
    )
    out["batch_assign"] = (
        with_(EXAMPLES, batches("batched", "examples", BATCH, "guid")) + "SELECT guid, batch_id, pos FROM batched"
    )
    out["reserved_ids"] = (
        with_(
            PROMPT_PHRASES,
            VOCAB,
            reserved("first_ids", str(VOCAB_SIZE), 0),
            reserved("second_ids", str(VOCAB_SIZE), SENTIMENT_IDS),
        )
        + """SELECT 'skip_first' AS strategy, task, kind, ord::INTEGER AS ord, token, old_id, new_id FROM first_ids
             UNION ALL SELECT 'skip_second', task, kind, ord::INTEGER, token, old_id, new_id FROM second_ids"""
    )
    out["best_so_far"] = with_(HISTORY, IMPROVED) + "SELECT run, step, value, best_before, improved FROM judged"
    out["early_stop"] = (
        with_(
            HISTORY,
            IMPROVED,
            "islands AS (SELECT *, sum(improved) OVER (PARTITION BY run ORDER BY step) AS island FROM judged)",
            """streaks AS (SELECT *, sum(1 - improved) OVER (PARTITION BY run, island ORDER BY step) AS streak
               FROM islands)""",
        )
        + f"""SELECT run, count(*) AS n_evals, min(step) FILTER (streak >= {PATIENCE}) AS stop_step
              FROM streaks GROUP BY run"""
    )
    out["test_on_improve"] = with_(HISTORY, IMPROVED) + "SELECT run, step, test_value FROM judged WHERE improved = 1"
    out["predict_argmax"] = with_(VECTOR_LOGITS, VECTOR_PREDICTIONS) + "SELECT guid, pred FROM preds"
    out["seeded_shuffle"] = (
        with_(EXAMPLES)
        + f"""SELECT guid, epoch, row_number() OVER (PARTITION BY epoch ORDER BY
              md5(concat_ws('-', {SEED}, epoch, guid)), guid) AS shuffle_pos
              FROM examples, (VALUES (1), (2)) e(epoch) WHERE split = 'train'"""
    )
    best = "best AS (SELECT run, step, value FROM history QUALIFY row_number() OVER (PARTITION BY run ORDER BY value DESC, step) = 1)"
    out["best_checkpoint"] = with_(HISTORY, best) + "SELECT run, step AS best_step, value AS best_value FROM best"
    short = with_(*ENCODE_BASE, encoded(SHORT_LEN))
    out["truncate_parts"] = short + (
        f"SELECT guid, task, {words('list(kept::INTEGER ORDER BY slot_no)')} AS kept FROM cut GROUP BY guid, task"
    )
    out["few_shot_sample"] = with_(EXAMPLES, SAMPLE) + "SELECT seed, rank, guid, label FROM sample"
    out["concat_batches"] = (
        with_(*TOXIC_HELD)
        + """SELECT guid, split, pred FROM preds WHERE split = 'dev'
             UNION ALL SELECT guid, split, pred FROM preds WHERE split = 'test'"""
    )
    out["metrics_by_split"] = with_(*TOXIC_HELD) + binary("preds", "split")
    out["tokenize"] = (
        f"SELECT doc_id AS guid, len({tokens('text')})::INTEGER AS n_tokens, {words(tokens('text'))} AS tokens FROM documents"
    )
    out["encode_padded"] = (
        with_(*ENCODE_BASE, encoded(MAX_LEN), padded(MAX_LEN))
        + f"""SELECT guid, task, label AS label_id, senti_pre, {words("ids")} AS input_ids, {words("mask")} AS attention_mask,
              {words("types")} AS token_type_ids, {words("flags")} AS pet_flags FROM padded"""
    )
    out["softmax_probs"] = with_(VECTOR_LOGITS, SOFTMAX) + f"SELECT guid, class, {rnd('prob')} AS prob FROM probs"
    out["ce_labels"] = (
        with_(VECTOR_LOGITS)
        + f"""SELECT guid, (list_position([{WORDS_3}], label) - 1)::INTEGER AS label_id,
              {rnd("max(logit) + ln(sum(exp(logit - top))) - max(logit) FILTER (class = label)")} AS ce
              FROM (SELECT *, max(logit) OVER (PARTITION BY guid) AS top FROM logits10
                    WHERE label IN ({WORDS_3}) AND class IN ({WORDS_3})) GROUP BY guid, label"""
    )
    out["ce_full"] = with_(VECTOR_LOGITS, CE_FULL) + f"SELECT guid, {rnd('ce')} AS ce FROM ce_full"
    out["checkpoint_name"] = (
        with_(HISTORY, best) + "SELECT run, 'output/' || round(value, 2)::DOUBLE || '/' AS name FROM best"
    )
    unit = f"(('0x' || substr(md5(concat_ws('-', {SEED}, vec_id, i)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
    out["embedding_random_init"] = (
        with_(
            *VECTOR_REMAP,
            """items AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS i,
                                unnest(embedding)::DOUBLE AS x FROM embeddings)""",
            "bounded AS (SELECT *, max(abs(x)) OVER (PARTITION BY vec_id) AS bound FROM items)",
        )
        + f"""SELECT vec_id, i, {rnd(f"CASE WHEN r.new_id IS NULL THEN x ELSE (({unit} * 2 - 1) * bound)::FLOAT::DOUBLE END")} AS x
              FROM bounded LEFT JOIN remap r ON r.new_id = vec_id AND r.task = 'sbic'"""
    )
    out["batch_scorer"] = (
        with_(
            *ENCODE_BASE,
            encoded(MAX_LEN),
            padded(MAX_LEN),
            """bases AS (SELECT guid, list_sum(ids)::BIGINT + 3 * list_sum(types)::BIGINT
                         + 7 * (list_position(flags, -1) - 1)::BIGINT AS base FROM padded)""",
        )
        + f"""SELECT guid, class, {rnd("((base * (class + 1)) % 1009) / 1009")} AS logit
              FROM bases, (VALUES (0), (1)) c(class)"""
    )
    out["score_tokens"] = (
        with_(*TOXIC, DOCUMENT_TOKENS, scored("doc", "toxic", "docs"))
        + f"SELECT guid, class::INTEGER AS class, {rnd('units / 1e9', 4)} AS logit FROM doc_units"
    )
    senti_held = with_(*SENTI, HELD_OUT, scored("held", "senti", "held_out"))
    out["stage1_sentiment"] = senti_held + (
        "SELECT guid, split, senti_gold, pred FROM held_out JOIN held_pred USING (guid)"
    )
    found, body = macro("preds", "split")
    out["stage1_metrics"] = (
        with_(
            *SENTI,
            HELD_OUT,
            scored("held", "senti", "held_out"),
            "preds AS (SELECT guid, split, senti_gold AS label, pred FROM held_out JOIN held_pred USING (guid))",
            found,
        )
        + body
    )
    out["stage2_annotate"] = (
        with_(
            *SENTI_DOCUMENTS,
            f"turns AS (SELECT conv_id || '-' || turn AS guid, conv_id, turn, text, {tokens('text')} AS tokens FROM conversations)",
            scored("turn", "senti", "turns"),
        )
        + """SELECT 'documents' AS corpus, doc_id AS guid, 0::BIGINT AS turn, text, pred AS senti_pre
             FROM documents JOIN doc_pred ON guid = doc_id
             UNION ALL SELECT 'conversations', conv_id, turn, text, pred FROM turns JOIN turn_pred USING (guid)"""
    )
    yes = "1 / (1 + exp((max(units) FILTER (class = 0) - max(units) FILTER (class = 1)) / 1e9))"
    out["stage3_classify"] = (
        with_(*STAGE3, f"yes AS (SELECT guid, {yes} AS prob FROM held_units GROUP BY guid)")
        + f"SELECT guid, split, label, senti_pre, pred, {rnd('prob', 4)} AS prob_yes FROM preds JOIN yes USING (guid)"
    )
    out["stage3_metrics"] = with_(*STAGE3) + binary("preds", "split")
    out["stage2_rejects"] = senti_docs + (
        "SELECT doc_id AS guid, CASE WHEN doc_id % 13 <> 0 THEN pred END AS senti_pre,"
        " CASE WHEN doc_id % 13 = 0 THEN 'null text' END AS reason FROM documents JOIN doc_pred ON guid = doc_id"
    )
    out["stage3_rejects"] = (
        with_(EXAMPLES)
        + """SELECT guid, split, CASE WHEN guid % 13 = 0 THEN 'null text' WHEN guid % 11 IN (0, 1) THEN 'unknown label'
             WHEN guid % 7 = 0 THEN 'sentiment out of range' END AS reason FROM examples"""
    )
    out["encode_rejects"] = short + (
        "SELECT guid, task, 'prompt does not fit' AS reason FROM parts GROUP BY guid, task"
        f" HAVING sum(len(ids)) FILTER (slot <> '[text_a]') > {SHORT_LEN - 4}"
    )
    out["encode_own_task"] = own_task()
    out["evaluate_saved"] = (
        with_(
            *STAGE3[:-3],
            "held_out AS (SELECT * FROM annotated WHERE split = 'test')",
            *STAGE3[-2:],
            f"judged AS ({binary('preds')})",
            unit_losses("ces", "held_units", "held_out"),
            batches("batched", "ces", TRAIN_BATCH),
            BATCH_LOSS,
        )
        + f"""SELECT 'test' AS split, metric, value
          FROM (UNPIVOT judged ON precision, accuracy, f1_score INTO NAME metric VALUE value)
          UNION ALL SELECT 'test', 'loss', {rnd("sum(loss)")} FROM batch_loss"""
    )
    three = [part.replace("label, split, pred AS senti_pre", "senti_gold AS label, split, pred AS senti_pre") for part in SENTI_EXAMPLES]
    out["stage3_multiclass"] = (
        with_(
            *three,
            SAMPLE,
            STAGE3[-5],
            trained("few", "shots", "label", 3),
            "held_out AS (SELECT * FROM annotated WHERE split <> 'train')",
            scored("held", "few", "held_out"),
            "preds AS (SELECT h.guid, h.split, h.label, pred, h.split AS k FROM held_out h JOIN held_pred USING (guid))",
            "units AS (SELECT u.guid, h.split, h.label, h.split AS k, u.class, u.units FROM held_units u JOIN held_out h USING (guid))",
            *judged_by_key(3),
        )
        + "SELECT split, n_rows, accuracy, f1_score, AUROC_score, undefined_pairs, loss FROM"
        " (SELECT DISTINCT k, split FROM preds) s JOIN macro_by USING (k) JOIN auroc_by USING (k) JOIN loss_by USING (k)"
    )
    out["sweep_metrics"] = (
        with_(*SENTI_EXAMPLES, *sweep_units(2), *judged_by_key(2, multiclass=False), f"found AS ({binary('preds', 'k')})", KEYS)
        + f"SELECT n, seed, split, n_rows, precision, accuracy, f1_score, loss FROM keys JOIN found USING (k) JOIN loss_by USING (k)"
    )
    out["sweep_multiclass"] = (
        with_(*three, *sweep_units(3), *judged_by_key(3), KEYS)
        + "SELECT n, seed, split, n_rows, accuracy, f1_score, AUROC_score, undefined_pairs, loss"
        " FROM keys JOIN macro_by USING (k) JOIN auroc_by USING (k) JOIN loss_by USING (k)"
    )
    return out
