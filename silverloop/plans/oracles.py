"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

import re

from silverloop.functions import prompts
from silverloop.plans import fixtures as fx

ORACLES: dict[str, str] = {}


# -- pieces of SQL ------------------------------------------------------------


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled(template: str, **slots: str) -> str:
    """A template as a concatenation of literals and columns."""
    pieces = re.split(r"<<(\w+)>>", template)
    parts = [f"coalesce({slots[p]}, '')" if i % 2 else lit(p) for i, p in enumerate(pieces) if p]
    return "(" + " || ".join(parts) + ")"


def fixed_length(template: str) -> int:
    """Characters of a template without its slots."""
    return len(re.sub(r"<<\w+>>", "", template))


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def number(c: str) -> str:
    return f"try_cast({strip(c)} AS DOUBLE)"


def int01(c: str) -> str:
    word = f"lower({strip(c)})"
    return f"""CASE WHEN {word} IN ('1', 'true', 'green', 'yes', 'y') THEN 1
      WHEN {word} IN ('0', 'false', 'not_green', 'no', 'n') THEN 0
      WHEN isfinite({number(c)}) THEN CASE WHEN trunc({number(c)}) = 1 THEN 1 ELSE 0 END END"""


def binary(c: str) -> str:
    return f"CASE WHEN {number(c)} IN (0, 1) THEN CAST({number(c)} AS INTEGER) END"


def clean_id(c: str) -> str:
    return f"""CASE WHEN {number(c)} IS NOT NULL THEN CAST(CAST(round_even({number(c)}, 0) AS BIGINT) AS VARCHAR)
      ELSE nullif(regexp_replace({c}, '\\D', '', 'g'), '') END"""


def r6(c: str) -> str:
    return f"(round({c}, 6) + 0.0)"


def r6_list(c: str) -> str:
    return f"list_transform({c}, lambda x: round(x, 6) + CAST(0 AS DOUBLE))"


def ratio(top: str, bottom: str) -> str:
    return f"CASE WHEN ({bottom}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({top} AS DOUBLE) / ({bottom}) END"


def tokens(c: str) -> str:
    trimmed = rf"trim({c}, E' \t\n\r\f')"
    return rf"CASE WHEN {trimmed} = '' THEN [] ELSE regexp_split_to_array({trimmed}, E'[ \t\n\r\f]+') END"


CORPUS = fx.sql(fx.CORPUS)
CORPUS_MESSY = fx.sql(fx.CORPUS_MESSY)
REVIEWED = fx.sql(fx.REVIEWED)
REVIEW_LIST = fx.sql(fx.REVIEW_LIST)
PREDICTIONS = fx.sql(fx.PREDICTIONS)
WIDE = fx.sql(fx.CLAIMS_WIDE)
WEIGHTS = "[" + ", ".join(f"CAST({w} AS DOUBLE)" for w in fx.WEIGHTS) + "]"

# -- sources, sinks, contracts ------------------------------------------------

_DOCS = "SELECT doc_id, text, lang, source, n_chars"
ORACLES["read_table_auto"] = f"{_DOCS}, 'parquet' AS src FROM documents UNION ALL {_DOCS}, 'csv' FROM documents"
ORACLES["read_csv_strings"] = f"""SELECT doc_id, text, coalesce(llm_green_suggested, '') AS llm_green_suggested,
  coalesce(llm_confidence, '') AS llm_confidence, coalesce(llm_rationale, '') AS llm_rationale FROM {REVIEW_LIST}"""
ORACLES["write_splits"] = f"SELECT id, text, is_green_silver, split FROM {CORPUS} WHERE split = 'eval_silver'"
ORACLES["write_csv"] = "SELECT conv_id, turn, role, text FROM conversations"
ORACLES["embedding_store"] = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings"

_CELLS = f"""SELECT count(*) AS n, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn,
  count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn,
  count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp FROM {{rows}}"""


def prf(rows: str) -> str:
    return f"""SELECT n, {r6(ratio('tp + tn', 'n'))} AS accuracy, {r6(ratio('tp', 'tp + fp'))} AS precision,
  {r6(ratio('tp', 'tp + fn'))} AS recall, {r6(ratio('2 * tp', '2 * tp + fp + fn'))} AS f1
FROM ({_CELLS.format(rows=rows)})"""


def report(rows: str) -> str:
    measures = ["precision", "recall", "f1"]
    macro = ", ".join(f"avg({m}) AS {m}" for m in measures)
    weighted = ", ".join(f"sum({m} * support) / sum(support) AS {m}" for m in measures)
    rounded = ", ".join(f"round({m}, 4) AS {m}" for m in measures)
    return f"""WITH p AS (SELECT y_true, y_pred FROM {rows}),
c AS (SELECT y_true AS c FROM p UNION SELECT y_pred FROM p),
k AS (SELECT c, (SELECT count(*) FROM p WHERE y_true = c) AS support, (SELECT count(*) FROM p WHERE y_pred = c) AS said,
  (SELECT count(*) FROM p WHERE y_true = c AND y_pred = c) AS hit FROM c),
m AS (SELECT CAST(c AS VARCHAR) AS class, {ratio('hit', 'said')} AS precision, {ratio('hit', 'support')} AS recall,
  {ratio('2 * hit', 'said + support')} AS f1, support, hit FROM k),
u AS (SELECT class, precision, recall, f1, CAST(support AS BIGINT) AS support FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, CAST(sum(hit) AS DOUBLE) / sum(support), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', {macro}, CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', {weighted}, CAST(sum(support) AS BIGINT) FROM m)
SELECT class, {rounded}, support FROM u"""


_LOSS = f"-avg(ln(greatest(CASE WHEN y_true = 1 THEN p_true ELSE 1 - p_true END, 1e-15)))"


def cell_rows(rows: str) -> str:
    return f"""SELECT y.v AS true_label, p.v AS pred_label,
  (SELECT count(*) FROM {rows} r WHERE r.y_true = y.v AND r.y_pred = p.v) AS n
FROM (VALUES (0), (1)) y(v), (VALUES (0), (1)) p(v)"""


def metric_rows(rows: str) -> str:
    """``section``, ``class``, ``metric``, ``value`` of predictions."""
    return f"""SELECT 'summary' AS section, NULL AS class, unnest(['n', 'accuracy', 'precision', 'recall', 'f1']) AS metric,
    unnest([CAST(n AS DOUBLE), accuracy, precision, recall, f1]) AS value FROM ({prf(rows)})
  UNION ALL SELECT 'confusion_matrix', CAST(true_label AS VARCHAR), 'pred_' || CAST(pred_label AS VARCHAR), CAST(n AS DOUBLE) FROM ({cell_rows(rows)})
  UNION ALL SELECT 'report', class, unnest(['precision', 'recall', 'f1', 'support']), unnest([precision, recall, f1, CAST(support AS DOUBLE)]) FROM ({report(rows)})
  UNION ALL SELECT 'summary', NULL, 'log_loss', {_LOSS} FROM {rows}"""


ORACLES["metrics_sink"] = f"""SELECT run, section, class, metric, {r6('value')} AS value
FROM ({metric_rows(PREDICTIONS)}), (VALUES ('first'), ('second')) r(run)"""
ORACLES["check_contract"] = f"""WITH k AS (SELECT {clean_id('doc_id')} AS id FROM {REVIEWED})
SELECT count(*) AS n_rows, count(*) - count(id) AS n_null_keys, count(id) - count(DISTINCT id) AS n_duplicate_keys,
  count(*) > 0 AS has_rows FROM k"""

# -- projections, filters, cleaning -------------------------------------------

ORACLES["select_prefix"] = f"SELECT id, Y02_purchase, Y02_signup FROM {WIDE}"
ORACLES["any_positive_label"] = f"""SELECT id,
  CASE WHEN coalesce(Y02_purchase, 0) + coalesce(Y02_signup, 0) > 0 THEN 1 ELSE 0 END AS is_green_silver FROM {WIDE}"""
ORACLES["split_filter"] = (
    f"SELECT id, text, is_green_silver, split FROM {CORPUS_MESSY} WHERE lower(trim(split)) = 'train_silver'"
)
ORACLES["project_rename"] = f"SELECT id AS doc_id, text, is_green_silver AS label FROM {CORPUS}"
ORACLES["coerce_binary"] = f"""SELECT id, coalesce(text, '') AS text, {binary('is_green_silver')} AS label
FROM {CORPUS} WHERE {binary('is_green_silver')} IS NOT NULL"""
ORACLES["to_int01"] = f"SELECT id, is_green_silver, {int01('is_green_silver')} AS gold01 FROM {CORPUS}"
ORACLES["clean_doc_id"] = f"SELECT doc_id, source_pos, {clean_id('doc_id')} AS clean_id FROM {REVIEWED}"
ORACLES["text_or_empty"] = f"SELECT id, coalesce(text, '') AS text FROM {CORPUS}"
ORACLES["drop_incomplete"] = f"""SELECT id, text, is_green_silver, split FROM {CORPUS}
WHERE text IS NOT NULL AND is_green_silver IS NOT NULL"""
ORACLES["ensure_columns"] = f"""SELECT doc_id, llm_confidence, '' AS llm_green_suggested, '' AS llm_rationale,
  '' AS is_green_human, '' AS human_notes, false AS parse_failed FROM {REVIEW_LIST}"""
ORACLES["pending_filter"] = f"""SELECT doc_id, llm_green_suggested, llm_confidence, llm_rationale FROM {REVIEW_LIST}
WHERE NOT (coalesce(llm_green_suggested, '') IN ('0', '1') AND coalesce(llm_confidence, '') <> ''
  AND coalesce(llm_rationale, '') <> '')"""
ORACLES["row_cap"] = "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 500"

# -- joins --------------------------------------------------------------------

# The last valid reviewed row of every id.
_GOLD = f"""(SELECT gold_id, human FROM (
  SELECT {clean_id('doc_id')} AS gold_id, {binary('is_green_human')} AS human, source_pos FROM {REVIEWED})
WHERE gold_id IS NOT NULL AND human IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY gold_id ORDER BY source_pos DESC) = 1)"""
_JOINED = f"(SELECT c.*, g.human FROM {CORPUS} c LEFT JOIN {_GOLD} g ON c.id = g.gold_id)"
ORACLES["gold_join"] = f"SELECT id, split, human AS is_green_human FROM {_JOINED}"
ORACLES["gold_override"] = (
    f"SELECT id, split, coalesce(human, {binary('is_green_silver')}) AS is_green_gold FROM {_JOINED}"
)
ORACLES["gold_matched"] = f"SELECT id, text, human AS is_green_human FROM {_JOINED} WHERE human IS NOT NULL"
ORACLES["exclude_ids"] = f"""SELECT id, text, is_green_silver, split FROM {CORPUS} c
WHERE NOT EXISTS (SELECT 1 FROM {REVIEWED} r WHERE {clean_id('r.doc_id')} = c.id)"""
_HASH = "md5('42:' || CAST(doc_id AS VARCHAR))"
ORACLES["complement"] = f"""SELECT doc_id, quality, toxic FROM labels
WHERE doc_id NOT IN (SELECT doc_id FROM labels ORDER BY {_HASH} LIMIT 50)"""
ORACLES["embedding_align"] = """SELECT doc_id, lang, CAST(embedding AS DOUBLE[]) AS embedding
FROM documents LEFT JOIN embeddings ON doc_id = vec_id"""
ORACLES["token_lookup"] = f"""WITH t AS (SELECT conv_id, turn, {tokens('text')} AS l FROM conversations),
w AS (SELECT conv_id, turn, CAST(unnest(generate_series(0, len(l) - 1)) AS INTEGER) AS pos, unnest(l) AS token FROM t)
SELECT conv_id, turn, pos, token, [CAST(length(token) AS DOUBLE), CAST(length(replace(token, 'e', '')) AS DOUBLE)] AS vec
FROM w"""

# -- aggregations -------------------------------------------------------------

ORACLES["label_counts"] = f"""SELECT is_green_silver, count(*) AS n FROM {CORPUS}
WHERE is_green_silver IS NOT NULL GROUP BY 1"""
ORACLES["split_distribution"] = f"SELECT split, count(*) AS n FROM {CORPUS_MESSY} GROUP BY 1"
ORACLES["confusion_matrix"] = cell_rows(PREDICTIONS)
ORACLES["prf_binary"] = prf(PREDICTIONS)
ORACLES["classification_report"] = report(PREDICTIONS)
ORACLES["log_loss"] = f"SELECT {r6(_LOSS)} AS log_loss FROM {PREDICTIONS}"

# -- ranking, samples, splits -------------------------------------------------

ORACLES["keep_last_by_file_order"] = """SELECT 'last' AS kind, lang, source, doc_id, nullif(text, '') AS text FROM documents
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id DESC) = 1
UNION ALL SELECT 'first 500', lang, source, doc_id, nullif(text, '') FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= 500"""
ORACLES["dedupe_keep_last"] = f"""SELECT {clean_id('doc_id')} AS doc_id, text, is_green_human, source_pos FROM {REVIEWED}
QUALIFY row_number() OVER (PARTITION BY {clean_id('doc_id')} ORDER BY source_pos DESC) = 1"""
_PROBABILITY = f"1 / (1 + exp(-(list_dot_product(CAST(embedding AS DOUBLE[]), {WEIGHTS}) + {fx.INTERCEPT})))"
_SCORED = f"(SELECT *, {_PROBABILITY} AS p FROM embeddings)"
ORACLES["top_uncertain"] = f"""SELECT vec_id, {r6('1 - 2 * abs(p - 0.5)')} AS u FROM {_SCORED}
ORDER BY 1 - 2 * abs(p - 0.5) DESC, vec_id LIMIT 100"""
ORACLES["class_sample"] = f"""SELECT doc_id, quality, toxic FROM labels
QUALIFY row_number() OVER (PARTITION BY quality ORDER BY {_HASH}) <= 10"""
ORACLES["seeded_shuffle"] = f"SELECT doc_id, source, row_number() OVER (ORDER BY {_HASH}) - 1 AS row_index FROM documents"
ORACLES["cap_sample"] = f"SELECT doc_id, text FROM documents ORDER BY {_HASH} LIMIT 300"
_60_20_20 = """CASE WHEN rk <= round_even(CAST(0.6 AS DOUBLE) * n, 0) THEN 'train_silver'
  WHEN rk <= round_even(CAST(0.6 AS DOUBLE) * n, 0) + round_even((n - round_even(CAST(0.6 AS DOUBLE) * n, 0)) * 0.5, 0)
  THEN 'eval_silver' ELSE 'pool_unlabeled' END AS split"""
ORACLES["split_60_20_20"] = f"""SELECT doc_id, lang, {_60_20_20}
FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY {_HASH}) AS rk, count(*) OVER () AS n FROM documents)"""
ORACLES["stratified_split"] = f"""WITH n AS (SELECT quality, count(*) AS c, sum(count(*)) OVER () AS n_all FROM labels GROUP BY 1),
q AS (SELECT quality, c, n_all, ceil(n_all * CAST(0.15 AS DOUBLE)) AS n_test FROM n),
s AS (SELECT quality, n_test, floor(n_test * c / n_all) AS whole, (n_test * c) % n_all AS rest FROM q),
w AS (SELECT quality, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, quality) <= n_test - sum(whole) OVER ()
  THEN 1 ELSE 0 END AS want FROM s)
SELECT doc_id, l.quality, toxic,
  CASE WHEN row_number() OVER (PARTITION BY l.quality ORDER BY {_HASH}) <= want THEN 'test' ELSE 'train' END AS part
FROM labels l JOIN w ON l.quality = w.quality"""

# -- training sets ------------------------------------------------------------

ORACLES["union_all"] = """SELECT doc_id AS id, text, lang FROM documents
UNION ALL SELECT item_id, text, NULL FROM benchmark"""
ORACLES["augment_replace"] = f"""WITH j AS (SELECT * FROM {_JOINED}),
u AS (SELECT text, {binary('is_green_silver')} AS label FROM j WHERE split = 'train_silver'
    AND id NOT IN (SELECT id FROM j WHERE human IS NOT NULL)
  UNION ALL SELECT text, human FROM j WHERE human IS NOT NULL)
SELECT coalesce(text, '') AS text, label FROM u WHERE label IS NOT NULL"""
ORACLES["augment_append"] = f"""WITH u AS (
  SELECT text, {binary('is_green_silver')} AS label FROM {CORPUS} WHERE split = 'train_silver'
  UNION ALL SELECT text, {binary('is_green_human')} FROM {REVIEWED})
SELECT coalesce(text, '') AS text, label FROM u WHERE label IS NOT NULL"""

# -- text and replies ---------------------------------------------------------

_TEMPLATE = {name: prompts.template_text(name) for name in prompts.TEMPLATES}
ORACLES["render_prompt"] = f"""SELECT doc_id, {filled(_TEMPLATE['labeller'], claim='text')} AS labeller,
  {filled(_TEMPLATE['advocate'], claim='text')} AS advocate, {filled(_TEMPLATE['skeptic'], claim='text')} AS skeptic,
  {filled(_TEMPLATE['judge'], claim='text', advocate='lang', skeptic='source')} AS judge,
  {filled(_TEMPLATE['classifier'], claim='text')} AS classifier FROM documents"""
ORACLES["chat_render"] = """WITH m AS (SELECT conv_id, turn, role, text,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, string_agg(CASE role WHEN 'system' THEN '[INST] ' || text || E'\\n\\n'
    WHEN 'user' THEN CASE WHEN before = 'system' THEN '' ELSE '[INST] ' END || text || ' [/INST]'
    ELSE ' ' || text || '</s>' END, '' ORDER BY turn) AS chat
FROM m GROUP BY 1"""
_TARGET = f"CASE WHEN label01 = 1 THEN {lit(prompts.TARGET_GREEN)} ELSE {lit(prompts.TARGET_NOT_GREEN)} END"
ORACLES["sft_target"] = f"""SELECT id, {_TARGET} AS target
FROM (SELECT id, {int01('is_green_silver')} AS label01 FROM {CORPUS}) WHERE label01 IS NOT NULL"""
_CLASSIFIER = (
    prompts.BEGIN + prompts.OPEN + prompts.CLASSIFIER_SYSTEM + "\n\n" + prompts.CLASSIFIER_USER + prompts.CLOSE
)
ORACLES["sft_records"] = f"""SELECT id, {filled(_CLASSIFIER, claim='text')} || {_TARGET} || '</s>' AS text
FROM (SELECT id, text, {int01('is_green_silver')} AS label01 FROM {CORPUS_MESSY} c
  WHERE lower(trim(split)) = 'train_silver' AND text IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM {REVIEWED} r WHERE {clean_id('r.doc_id')} = c.id))
WHERE label01 IS NOT NULL ORDER BY md5('42:' || id) LIMIT 10000"""

_LINES = r"regexp_split_to_array(reply, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"


def kv_line(key: str) -> str:
    trimmed = f"list_transform({_LINES}, lambda x: {strip('x')})"
    found = f"list_filter({trimmed}, lambda x: starts_with(lower(x), '{key}:'))[-1]"
    return f"coalesce({strip(f'substr({found}, {len(key) + 2})')}, '')"


ORACLES["parse_kv_response"] = f"""WITH f AS (SELECT doc_id, reply, {kv_line('label')} AS a, lower({kv_line('confidence')}) AS b,
  {kv_line('rationale')} AS c FROM {fx.sql(fx.REPLIES_KV)})
SELECT doc_id, CASE WHEN a IN ('0', '1') THEN a ELSE '0' END AS label,
  CASE WHEN b IN ('low', 'medium', 'high') THEN b ELSE 'low' END AS confidence,
  CASE WHEN c <> '' THEN c ELSE substr({strip('reply')}, 1, 300) END AS rationale FROM f"""


def as_int01(obj: str) -> str:
    kind, value = f"json_type({obj}, '$.label')", f"json_extract_string({obj}, '$.label')"
    whole = f"""CASE WHEN {kind} = 'BOOLEAN' THEN CASE {value} WHEN 'true' THEN 1 ELSE 0 END
      WHEN {kind} = 'VARCHAR' THEN CASE WHEN regexp_full_match({strip(value)}, '[+-]?[0-9]+') THEN try_cast({strip(value)} AS DOUBLE) END
      WHEN {kind} IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN trunc(try_cast({value} AS DOUBLE)) END"""
    return f"CASE WHEN ({whole}) IN (0, 1) THEN CAST({whole} AS INTEGER) END"


_BLOCK = r"nullif(regexp_extract(reply, '(?s)\{.*?\}', 0), '')"
_OPENED = f"CASE WHEN starts_with({strip('reply')}, '{{') THEN {strip('reply')} ELSE '{{' || {strip('reply')} END"
_CLOSED = f"CASE WHEN ends_with({_OPENED}, '}}') THEN {_OPENED} ELSE {_OPENED} || '}}' END"
_OBJ = f"""(SELECT doc_id, reply, CASE WHEN json_valid({_BLOCK}) THEN {_BLOCK}
  WHEN {strip('reply')} <> '' AND json_valid({_CLOSED}) THEN {_CLOSED} END AS obj FROM {fx.sql(fx.REPLIES_JSON)})"""
_TOKEN_RE = r"""'("label"\s*:\s*([01]))|(\b([01])\b)'"""
_TOKEN = f"""CAST(coalesce(nullif(regexp_extract(reply, {_TOKEN_RE}, 2), ''),
  nullif(regexp_extract(reply, {_TOKEN_RE}, 4), '')) AS INTEGER)"""
ORACLES["json_first_object"] = f"""SELECT doc_id, obj IS NOT NULL AS parsed, json_extract_string(obj, '$.label') AS label,
  json_extract_string(obj, '$.rationale') AS rationale FROM {_OBJ}"""
ORACLES["label_fallback"] = f"SELECT doc_id, {_TOKEN} AS label FROM {fx.sql(fx.REPLIES_JSON)}"
_RESOLVED = f"""(SELECT doc_id, coalesce(l, {_TOKEN}) AS label,
  CASE WHEN l IS NOT NULL THEN json_extract_string(obj, '$.rationale') END AS rationale, l IS NOT NULL AS ok
FROM (SELECT *, {as_int01('obj')} AS l FROM {_OBJ}))"""
ORACLES["resolve_label"] = f"SELECT doc_id, label, rationale, ok FROM {_RESOLVED}"
ORACLES["parse_quality"] = f"""SELECT count(*) AS total, count(*) FILTER (label IS NOT NULL AND ok) AS clean,
  count(*) FILTER (label IS NOT NULL AND NOT ok) AS fallback, count(*) FILTER (label IS NULL) AS unparsed FROM {_RESOLVED}"""

_FIELD = {
    "label": r"""regexp_extract(reply, '"label"\s*:\s*([01])', 1)""",
    "confidence": r"""regexp_extract(reply, '"confidence"\s*:\s*"(low|medium|high)"', 1)""",
    "rationale": r"""CASE WHEN regexp_matches(reply, '"rationale"\s*:\s*"([^"]*)"')
      THEN regexp_extract(reply, '"rationale"\s*:\s*"([^"]*)"', 1) END""",
}
_SALVAGED = f"""(SELECT doc_id, reply, CASE WHEN json_valid(t) THEN t END AS obj FROM (SELECT doc_id, reply,
  coalesce({_BLOCK}, CASE WHEN {_FIELD['label']} <> '' THEN CAST(json_object('label', CAST({_FIELD['label']} AS INTEGER),
    'confidence', coalesce(nullif({_FIELD['confidence']}, ''), 'low'),
    'rationale', coalesce({_FIELD['rationale']}, 'No rationale extracted.')) AS VARCHAR) END, {strip('reply')}) AS t
  FROM (SELECT doc_id, judge_json AS reply FROM {fx.sql(fx.REPLIES_JUDGE)})))"""
ORACLES["salvage_json"] = f"""SELECT doc_id, obj IS NOT NULL AS parsed, json_extract_string(obj, '$.label') AS label,
  json_extract_string(obj, '$.confidence') AS confidence, json_extract_string(obj, '$.rationale') AS rationale
FROM {_SALVAGED}"""
_VERDICT = f"""(SELECT doc_id, l AS llm_green_suggested,
  CASE WHEN good AND json_extract_string(obj, '$.confidence') IN ('low', 'medium', 'high')
    THEN json_extract_string(obj, '$.confidence') ELSE 'low' END AS llm_confidence,
  CASE WHEN NOT good THEN 'PARSE FAILED. Raw: ' || substr(reply, 1, 300)
    WHEN json_type(obj, '$.rationale') IS NULL THEN '' WHEN json_type(obj, '$.rationale') = 'NULL' THEN 'None'
    ELSE json_extract_string(obj, '$.rationale') END AS llm_rationale, NOT good OR l IS NULL AS parse_failed
FROM (SELECT *, {as_int01('obj')} AS l, coalesce(json_type(obj) = 'OBJECT', false) AS good FROM {_SALVAGED}))"""
ORACLES["judge_columns"] = f"SELECT * FROM {_VERDICT}"
ORACLES["run_summary"] = f"""SELECT count(*) AS total, count(*) FILTER (llm_green_suggested = 1) AS green,
  count(*) FILTER (llm_green_suggested = 0) AS not_green, count(*) FILTER (parse_failed) AS parse_failed,
  count(*) FILTER (parse_failed) > 10 AS alert,
  round(count(*) FILTER (parse_failed)::DOUBLE / count(*), 6) AS failed_rate FROM {_VERDICT}"""
ORACLES["token_truncate"] = f"""SELECT doc_id, CAST(len(l[1:256]) AS BIGINT) AS n, array_to_string(l[1:256], ' ') AS text
FROM (SELECT doc_id, {tokens('text')} AS l FROM documents)"""
ORACLES["sequence_pack"] = f"""WITH t AS (SELECT doc_id, {tokens('text')} AS l FROM documents),
s AS (SELECT l, sum(len(l)) OVER (ORDER BY {_HASH} ROWS UNBOUNDED PRECEDING) - len(l) AS start FROM t WHERE len(l) > 0),
w AS (SELECT CAST(start AS BIGINT) + unnest(generate_series(0, len(l) - 1)) AS place, unnest(l) AS token FROM s)
SELECT place // 512 AS block_id, count(*) AS n_tokens, string_agg(token, ' ' ORDER BY place) AS text FROM w GROUP BY 1"""

# -- vectors, attention, fold -------------------------------------------------

ORACLES["uncertainty"] = f"SELECT doc_id, {r6('1 - 2 * abs(p_true - 0.5)')} AS u FROM {PREDICTIONS}"
ORACLES["masked_mean_pool"] = f"""WITH t AS (SELECT * FROM {fx.sql(fx.TOKENS)}),
m AS (SELECT doc_id, sum(mask) AS n FROM t GROUP BY 1),
d AS (SELECT doc_id, i, sum(mask * CAST(vec[i] AS DOUBLE)) AS s FROM t, generate_series(1, 64) g(i) GROUP BY 1, 2)
SELECT doc_id, list({r6('s / greatest(CAST(n AS DOUBLE), 1e-9)')} ORDER BY i) AS pooled FROM d JOIN m USING (doc_id) GROUP BY 1"""
_EMBEDDED = f"""t AS (SELECT doc_id, {tokens("coalesce(text, '')")} AS l FROM documents),
k AS (SELECT doc_id, unnest(l) AS token, (unnest(generate_series(1, len(l))) - 1) // 256 AS win FROM t),
w AS (SELECT doc_id, win, CAST('0x' || substr(md5(token), 1, 4) AS INTEGER) % 16 AS slot, count(*) AS c FROM k GROUP BY 1, 2, 3),
n AS (SELECT doc_id, win, count(*) AS n FROM k GROUP BY 1, 2),
s AS (SELECT doc_id, slot, sum(CAST(CAST(CAST(c AS DOUBLE) / n AS FLOAT) AS DOUBLE) * n) AS s FROM w JOIN n USING (doc_id, win) GROUP BY 1, 2),
e AS (SELECT t.doc_id, i, coalesce(s.s, 0) / greatest(CAST(len(l) AS DOUBLE), 1e-9) AS x
  FROM t CROSS JOIN generate_series(0, 15) g(i) LEFT JOIN s ON s.doc_id = t.doc_id AND s.slot = i)"""
ORACLES["embed_batches"] = f"""WITH {_EMBEDDED}
SELECT doc_id, list(round(CAST(CAST(x AS FLOAT) AS DOUBLE), 5) ORDER BY i) AS embedding FROM e GROUP BY 1"""
ORACLES["linear_score"] = f"""SELECT vec_id, {r6('p')} AS p_green, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction
FROM {_SCORED}"""
# The penalised loss is minimised by accelerated gradient steps; the last entry of w is the intercept, without penalty.
_FIT_STEPS = 1200
_FITTED = f"""x AS (SELECT vec_id, CASE WHEN label < 5 THEN 1.0 ELSE 0.0 END AS y, list_append(CAST(embedding AS DOUBLE[]), 1.0) AS v FROM embeddings),
d AS (SELECT list(v ORDER BY vec_id) AS vs, list(y ORDER BY vec_id) AS ys, count(*)::DOUBLE AS n FROM x),
c AS (SELECT list(col ORDER BY k) AS cols FROM (SELECT k, list(v[k] ORDER BY vec_id) AS col FROM x, generate_series(1, 65) g(k) GROUP BY k)),
s AS (SELECT 0.25 * max(list_sum(list_transform(v, lambda a: a * a))) + 1 / count(*)::DOUBLE AS l, 1 / count(*)::DOUBLE AS mu FROM x),
fit AS (
  SELECT 0 AS i, list_transform(generate_series(1, 65), lambda a: 0.0::DOUBLE) AS w, list_transform(generate_series(1, 65), lambda a: 0.0::DOUBLE) AS z
  UNION ALL
  SELECT i + 1, nw, list_transform(nw, lambda a, k: a + (sqrt(l) - sqrt(mu)) / (sqrt(l) + sqrt(mu)) * (a - w[k]))
  FROM (SELECT i, w, l, mu, list_transform(z, lambda a, k: a - (list_dot_product(cols[k], r) / n + CASE WHEN k < 65 THEN a / n ELSE 0 END) / l) AS nw
    FROM (SELECT i, w, z, l, mu, n, cols, list_transform(vs, lambda v, j: 1 / (1 + exp(-list_dot_product(v, z))) - ys[j]) AS r
      FROM fit, d, c, s WHERE i < {_FIT_STEPS}))),
m AS (SELECT w FROM fit WHERE i = {_FIT_STEPS}),
q AS (SELECT vec_id, CAST(y AS INTEGER) AS y, 1 / (1 + exp(-list_dot_product(v, w))) AS p FROM x, m)"""
ORACLES["fit_logreg"] = f"""WITH RECURSIVE {_FITTED} SELECT CAST(CASE WHEN k = 65 THEN -1 ELSE k - 1 END AS INTEGER) AS idx, round(w[k], 4) AS value
FROM m, generate_series(1, 65) g(k)"""
ORACLES["predict_proba"] = f"""WITH RECURSIVE {_FITTED} SELECT vec_id, y, round(p, 4) AS p_green, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction FROM q"""
ORACLES["model_store"] = f"""WITH RECURSIVE {_FITTED} SELECT vec_id, round(p, 4) AS p_green, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction FROM q"""


def retrained(train: str, held: str, run: str, dim: int = 16) -> str:
    """Metric rows of a fit on mean one-hot vectors of texts; ``train`` and ``held`` select text and label.

    The same steps as above. The last entry of a vector is 1, for the intercept.
    """
    zeros = f"list_transform(generate_series(0, {dim}), lambda a: 0.0::DOUBLE)"
    return f"""WITH RECURSIVE a AS MATERIALIZED (SELECT part, text, label, row_number() OVER () AS id
  FROM (SELECT 'train' AS part, text, label FROM ({train}) UNION ALL SELECT 'held', text, label FROM ({held}))),
t AS MATERIALIZED (SELECT part, id, label, {tokens('text')} AS l FROM a),
o AS (SELECT id, unnest(l) AS token FROM t),
k AS (SELECT id, CAST('0x' || substr(md5(token), 1, 4) AS INTEGER) % {dim} AS slot, count(*) AS c FROM o GROUP BY 1, 2),
x AS MATERIALIZED (SELECT part, t.id, CAST(label AS DOUBLE) AS y,
    list_append(list(coalesce(CAST(CAST(CAST(c AS DOUBLE) / len(l) AS FLOAT) AS DOUBLE), 0) ORDER BY i), 1.0::DOUBLE) AS v
  FROM t CROSS JOIN generate_series(0, {dim - 1}) g(i) LEFT JOIN k ON k.id = t.id AND slot = i GROUP BY part, t.id, label),
r AS (SELECT * FROM x WHERE part = 'train'),
d AS (SELECT list(v ORDER BY id) AS vs, list(y ORDER BY id) AS ys, count(*)::DOUBLE AS n FROM r),
c AS (SELECT list(col ORDER BY k) AS cols FROM (SELECT k, list(v[k] ORDER BY id) AS col FROM r, generate_series(1, {dim + 1}) g(k) GROUP BY k)),
s AS (SELECT 0.25 * max(list_sum(list_transform(v, lambda a: a * a))) + 1 / count(*)::DOUBLE AS l, 1 / count(*)::DOUBLE AS mu FROM r),
fit AS (
  SELECT 0 AS i, {zeros} AS w, {zeros} AS z
  UNION ALL
  SELECT i + 1, nw, list_transform(nw, lambda a, k: a + (sqrt(l) - sqrt(mu)) / (sqrt(l) + sqrt(mu)) * (a - w[k]))
  FROM (SELECT i, w, l, mu, list_transform(z, lambda a, k: a - (list_dot_product(cols[k], r) / n + CASE WHEN k <= {dim} THEN a / n ELSE 0 END) / l) AS nw
    FROM (SELECT i, w, z, l, mu, n, cols, list_transform(vs, lambda v, j: 1 / (1 + exp(-list_dot_product(v, z))) - ys[j]) AS r
      FROM fit, d, c, s WHERE i < {_FIT_STEPS}))),
m AS (SELECT w FROM fit WHERE i = {_FIT_STEPS}),
q AS MATERIALIZED (SELECT CAST(y AS INTEGER) AS y_true, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS y_pred, p AS p_true
  FROM (SELECT y, 1 / (1 + exp(-list_dot_product(v, w))) AS p FROM x, m WHERE part = 'held'))
SELECT '{run}' AS run, section, class, metric, round(value, 4) + 0.0 AS value FROM ({metric_rows('q')})"""


_EVAL = f"SELECT coalesce(text, '') AS text, {binary('is_green_silver')} AS label FROM {CORPUS} WHERE split = 'eval_silver' AND {binary('is_green_silver')} IS NOT NULL"
ORACLES["retrain_eval"] = retrained(ORACLES["augment_replace"], _EVAL, "replace")
ORACLES["retrain_eval_append"] = retrained(ORACLES["augment_append"], _EVAL, "append")
# As stratified_split, over the last reviewed row of every id.
_ALONE = f"""a AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, {binary('is_green_human')} AS label
  FROM ({ORACLES['dedupe_keep_last']}) WHERE {binary('is_green_human')} IS NOT NULL),
n AS (SELECT label, count(*) AS c, sum(count(*)) OVER () AS n_all FROM a GROUP BY 1),
q AS (SELECT label, c, n_all, ceil(n_all * CAST(0.15 AS DOUBLE)) AS n_test FROM n),
s AS (SELECT label, n_test, floor(n_test * c / n_all) AS whole, (n_test * c) % n_all AS rest FROM q),
w AS (SELECT label, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= n_test - sum(whole) OVER ()
  THEN 1 ELSE 0 END AS want FROM s),
h AS (SELECT text, a.label, row_number() OVER (PARTITION BY a.label ORDER BY md5(concat_ws(':', '42', doc_id))) <= want AS is_test
  FROM a JOIN w ON a.label = w.label)"""
ORACLES["retrain_eval_stratified"] = retrained(f"WITH {_ALONE} SELECT text, label FROM h WHERE NOT is_test", f"WITH {_ALONE} SELECT text, label FROM h WHERE is_test", "stratified")
ORACLES["argmax_label"] = """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best
FROM embeddings"""

_PAIRS = f"""s AS (SELECT sentence, pos, CAST(vec AS DOUBLE[]) AS v FROM {fx.sql(fx.SENTENCES)}),
p AS (SELECT q.sentence, q.pos AS q_pos, k.pos AS k_pos, k.v, list_dot_product(q.v, k.v) AS score
  FROM s q JOIN s k ON q.sentence = k.sentence),
e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY sentence, q_pos)) AS e FROM p),
w AS (SELECT *, e / sum(e) OVER (PARTITION BY sentence, q_pos) AS weight FROM e)"""
ORACLES["attention_scores"] = f"""WITH {_PAIRS} SELECT sentence, q_pos, k_pos // 4 AS k_block,
  list({r6('score')} ORDER BY k_pos) AS scores FROM w GROUP BY 1, 2, 3"""
ORACLES["attention_weights"] = f"""WITH {_PAIRS} SELECT sentence, q_pos, k_pos // 4 AS k_block,
  list({r6('weight')} ORDER BY k_pos) AS weights FROM w GROUP BY 1, 2, 3"""
ORACLES["attention_top"] = f"""WITH {_PAIRS} SELECT sentence, q_pos, row_number() OVER best AS rank, k_pos, {r6('score')} AS score, {r6('weight')} AS weight
  FROM w WINDOW best AS (PARTITION BY sentence, q_pos ORDER BY score DESC, k_pos) QUALIFY rank <= 3"""
_CONTEXT = f"""{_PAIRS}, d AS (SELECT sentence, q_pos AS pos, i, sum(weight * v[i]) AS x
  FROM w, generate_series(1, 64) g(i) GROUP BY 1, 2, 3),
c AS (SELECT sentence, pos, list({r6('x')} ORDER BY i) AS context FROM d GROUP BY 1, 2)"""
ORACLES["attention_output"] = f"WITH {_CONTEXT} SELECT sentence, pos, context FROM c"
ORACLES["attention_append"] = f"""WITH {_CONTEXT} SELECT sentence, pos, context FROM c
UNION ALL SELECT sentence - 1, 8, {r6_list('v')} FROM s WHERE pos = 0 AND sentence > 0"""

_STEP = "w_old - 1e-6 * (2 * x * (x * w_old - t))"
ORACLES["sgd_trace"] = f"""WITH RECURSIVE r AS (SELECT supp, pos, x, t,
  row_number() OVER (PARTITION BY supp ORDER BY pos, x, t) AS rn FROM {fx.sql(fx.SAMPLES)}),
f AS (SELECT supp, pos, x, t, rn, CAST(0.5 AS DOUBLE) AS w_old FROM r WHERE rn = 1
  UNION ALL SELECT r.supp, r.pos, r.x, r.t, r.rn, f.w_old - CAST(1e-6 AS DOUBLE) * (2 * f.x * (f.x * f.w_old - f.t))
  FROM f JOIN r ON r.supp = f.supp AND r.rn = f.rn + 1)
SELECT supp, pos, x, round(w_old, 4) AS w_old, round(x * w_old, 4) AS prediction, round(pow(t - x * w_old, 2), 4) AS loss,
  round(2 * x * (x * w_old - t), 4) AS gradient, round({_STEP}, 4) AS w_new FROM f"""

# -- batch inference, incremental runs, user functions ------------------------

_KV_N = f"({fixed_length(_TEMPLATE['labeller'])} + length(coalesce(text, '')))"
_KV_LEVEL = f"CASE {_KV_N} % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'medium' ELSE 'High' END"
_KV_BAD = f"'I cannot decide, ' || CAST({_KV_N} AS VARCHAR) || ' characters.'"
ORACLES["map_column"] = r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\v]+')) AS n_words,
  length(coalesce(text, '')) - length(translate(coalesce(text, ''), 'aeiou', '')) + coalesce(length(lang), 0) AS n_vowels FROM documents"""
ORACLES["batch_generate"] = f"""SELECT doc_id, CASE WHEN {_KV_N} % 5 = 0 THEN {_KV_BAD}
  ELSE 'label: ' || CAST({_KV_N} % 2 AS VARCHAR) || chr(10) || 'confidence: ' || {_KV_LEVEL} || chr(10)
    || 'rationale: the prompt has ' || CAST({_KV_N} AS VARCHAR) || ' characters' END AS reply FROM documents"""
ORACLES["label_incremental"] = f"""SELECT CAST(doc_id AS BIGINT) AS doc_id,
  CASE WHEN {_KV_N} % 5 = 0 THEN '0' ELSE CAST({_KV_N} % 2 AS VARCHAR) END AS llm_green_suggested,
  CASE WHEN {_KV_N} % 5 = 0 THEN 'low' ELSE lower({_KV_LEVEL}) END AS llm_confidence,
  CASE WHEN {_KV_N} % 5 = 0 THEN {_KV_BAD} ELSE 'the prompt has ' || CAST({_KV_N} AS VARCHAR) || ' characters' END AS llm_rationale
FROM documents"""

ORACLES["label_incremental_batch"] = ORACLES["label_incremental"]
_HELD = f"""SELECT c.*, g.human FROM {CORPUS} c LEFT JOIN (SELECT gold_id, arg_max(human, source_pos) AS human FROM (
  SELECT {clean_id('doc_id')} AS gold_id, {binary('is_green_human')} AS human, source_pos FROM {REVIEWED})
  WHERE gold_id IS NOT NULL AND human IS NOT NULL GROUP BY 1) g ON {clean_id('c.id')} = g.gold_id WHERE c.split = 'eval_silver'"""
ORACLES["exclude_eval_gold"] = f"""SELECT coalesce(text, '') AS text, label FROM (
  SELECT text, {binary('is_green_silver')} AS label FROM ({_HELD}) WHERE human IS NULL) WHERE label IS NOT NULL"""
ORACLES["eval_gold_overlap"] = f"SELECT count(*) AS eval_gold_rows FROM ({_HELD}) WHERE human IS NOT NULL"

_ARGUED = f"""(SELECT doc_id, length(text) AS n_text,
  'advocate sees ' || CAST({fixed_length(_TEMPLATE['advocate'])} + length(text) AS VARCHAR) || ' characters.' AS adv,
  'skeptic sees ' || CAST({fixed_length(_TEMPLATE['skeptic'])} + length(text) AS VARCHAR) || ' characters.' AS skp
FROM documents)"""
_JUDGED = f"(SELECT *, {fixed_length(_TEMPLATE['judge'])} + n_text + length(adv) + length(skp) AS n FROM {_ARGUED})"
_JL, _JN = "CAST(n // 4 % 2 AS VARCHAR)", "CAST(n AS VARCHAR)"
ORACLES["debate"] = f"""SELECT doc_id, adv AS agent1_advocate, skp AS agent2_skeptic, CASE n % 4
  WHEN 0 THEN '{{"label": ' || {_JL} || ', "confidence": "high", "rationale": "n=' || {_JN} || '"}}'
  WHEN 1 THEN '"label": ' || {_JL} || ', "confidence": "medium"'
  WHEN 2 THEN '{{"label": 2, "confidence": "medium", "rationale": "n=' || {_JN} || '"}}'
  ELSE 'no verdict for ' || {_JN} END AS judge_json,
  CASE WHEN n % 4 < 2 THEN CAST(n // 4 % 2 AS INTEGER) END AS llm_green_suggested,
  CASE n % 4 WHEN 0 THEN 'high' WHEN 3 THEN 'low' ELSE 'medium' END AS llm_confidence,
  CASE n % 4 WHEN 1 THEN 'No rationale extracted.' WHEN 3 THEN 'PARSE FAILED. Raw: no verdict for ' || {_JN}
    ELSE 'n=' || {_JN} END AS llm_rationale, n % 4 >= 2 AS parse_failed
FROM {_JUDGED}"""

_CLASSIFIER_N = f"({fixed_length(_CLASSIFIER)} + length(coalesce(text, 'None')))"
_EVALUATED = f"""(SELECT id, y_true, CASE WHEN n % 4 = 3 THEN 0 ELSE CAST(n // 4 % 2 AS INTEGER) END AS y_pred,
  CASE WHEN n % 4 < 3 THEN CAST(n // 4 % 2 AS INTEGER) END AS label, n % 4 < 2 AS ok
FROM (SELECT id, {int01('is_green_silver')} AS y_true, {_CLASSIFIER_N} AS n FROM {CORPUS} WHERE text IS NOT NULL)
WHERE y_true IS NOT NULL)"""
ORACLES["evaluate_capped"] = f"SELECT * FROM {_EVALUATED}"
ORACLES["evaluate_capped_report"] = report(_EVALUATED)
_ANSWERED = f"""(SELECT source_pos, is_green_human, {int01('is_green_human')} AS gold01,
  CASE WHEN n % 4 < 3 THEN CAST(n // 4 % 2 AS INTEGER) END AS qlora_label,
  CASE WHEN n % 4 < 2 THEN 'n=' || CAST(n AS VARCHAR) END AS qlora_rationale,
  CASE n % 4 WHEN 0 THEN 'Answer: {{"label": ' || {_JL} || ', "rationale": "n=' || {_JN} || '"}}'
    WHEN 1 THEN '"label": ' || {_JL} || ', "rationale": "n=' || {_JN} || '"'
    WHEN 2 THEN 'the label is ' || {_JL} || ' I think' ELSE 'no idea' END AS qlora_raw, n % 4 < 2 AS qlora_json_ok
FROM (SELECT source_pos, is_green_human, {_CLASSIFIER_N} AS n FROM {REVIEWED}))"""
ORACLES["predict_and_score"] = f"SELECT * FROM {_ANSWERED}"
_SCORED_ROWS = f"""(SELECT gold01 AS y_true, qlora_label AS y_pred FROM {_ANSWERED}
WHERE gold01 IS NOT NULL AND qlora_label IS NOT NULL)"""
ORACLES["predict_and_score_metrics"] = prf(_SCORED_ROWS)
ORACLES["map_batches"] = "SELECT doc_id, upper(lang) AS lang, length(text) AS n FROM documents"

# -- workflows ----------------------------------------------------------------

_TEXT_SCORE = " + ".join(f"sum(CASE WHEN i = {i} THEN x * {w!r} ELSE 0 END)" for i, w in enumerate(fx.TEXT_WEIGHTS))
ORACLES["review_list"] = f"""WITH {_EMBEDDED},
p AS (SELECT doc_id, 1 / (1 + exp(-({_TEXT_SCORE} + {fx.INTERCEPT}))) AS p FROM e GROUP BY 1)
SELECT d.doc_id, d.text, {r6('p')} AS p_green, {r6('1 - 2 * abs(p - 0.5)')} AS u,
  '' AS llm_green_suggested, '' AS llm_confidence, '' AS llm_rationale, '' AS is_green_human, '' AS human_notes
FROM documents d JOIN p USING (doc_id)
WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)
ORDER BY 1 - 2 * abs(p - 0.5) DESC, d.doc_id LIMIT 100"""
_BY_ID = "md5('42:' || CAST(id AS VARCHAR))"
ORACLES["silver_corpus"] = f"""WITH l AS ({ORACLES['any_positive_label']}),
b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY is_green_silver ORDER BY {_BY_ID}) <= 7)
SELECT id, is_green_silver, {_60_20_20}
FROM (SELECT *, row_number() OVER (ORDER BY {_BY_ID}) AS rk, count(*) OVER () AS n FROM b)"""
