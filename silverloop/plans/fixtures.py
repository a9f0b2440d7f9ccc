"""Inputs of the registered queries, derived from the driver tables.

Each is one SELECT that Spark and DuckDB read alike; ``{documents}`` and the like
stand for the tables, and doubled braces are braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_DIRTY_ID = """CASE doc_id % 4 WHEN 0 THEN CAST(doc_id AS STRING) || '.0' WHEN 1 THEN ' ' || CAST(doc_id AS STRING) || ' '
    WHEN 2 THEN 'DOC-' || CAST(doc_id AS STRING) ELSE CAST(doc_id AS STRING) END"""

_TEXT = "CASE WHEN d.doc_id % 40 = 17 THEN NULL ELSE d.text END"

_SPLIT = """CASE WHEN d.doc_id % 5 < 3 THEN 'train_silver' WHEN d.doc_id % 5 = 3 THEN 'eval_silver'
    ELSE 'pool_unlabeled' END"""

_SILVER = """CASE d.doc_id % 16 WHEN 3 THEN '1.0' WHEN 5 THEN ' Yes ' WHEN 7 THEN 'not_green' WHEN 9 THEN 'abc'
    WHEN 11 THEN '1.9' WHEN 13 THEN NULL
    ELSE CAST(coalesce(l.quality, CAST(d.n_chars % 2 AS INT)) AS STRING) END"""

# The working table: every document, a dirty silver label, a split.
CORPUS = f"""SELECT CAST(d.doc_id AS STRING) AS id, {_TEXT} AS text, {_SILVER} AS is_green_silver, {_SPLIT} AS split
FROM {{documents}} d LEFT JOIN {{labels}} l ON d.doc_id = l.doc_id"""

# The same with split names as people type them.
CORPUS_MESSY = f"""SELECT id, text, is_green_silver,
  CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN ' ' || upper(split) || '  ' WHEN 1 THEN split ELSE NULL END AS split
FROM ({CORPUS}) c"""

_LABELLED = "SELECT d.doc_id, d.text, d.lang, l.quality FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"

# Reviewed rows: dirty ids, a few bad labels, every tenth row reviewed again.
REVIEWED = f"""SELECT {_DIRTY_ID} AS doc_id, text,
  CASE WHEN doc_id % 23 = 4 THEN 'x' ELSE CAST(answer AS STRING) END AS is_green_human, source_pos
FROM (SELECT doc_id, text, quality AS answer, doc_id * 2 AS source_pos FROM ({_LABELLED}) a
      UNION ALL
      SELECT doc_id, text, 1 - quality, doc_id * 2 + 1 FROM ({_LABELLED}) b WHERE doc_id % 10 = 0) r"""

# The review list with some rows already filled in.
REVIEW_LIST = """SELECT CAST(doc_id AS STRING) AS doc_id, text,
  CASE doc_id % 6 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN '2' WHEN 3 THEN NULL ELSE '' END AS llm_green_suggested,
  CASE doc_id % 4 WHEN 0 THEN '' ELSE 'low' END AS llm_confidence,
  CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'because of ' || source END AS llm_rationale
FROM {documents}"""

PREDICTIONS = """SELECT doc_id, quality AS y_true, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS y_pred,
  CAST(doc_id % 97 + 1 AS DOUBLE) / CAST(100 AS DOUBLE) AS p_true FROM {labels}"""

REPLIES_KV = """SELECT doc_id, CASE doc_id % 7
  WHEN 0 THEN 'Label: 1' || chr(10) || 'Confidence: HIGH' || chr(10) || 'rationale: cites ' || source
  WHEN 1 THEN 'label: 1' || chr(10) || 'label: 0' || chr(10) || 'rationale: ' || lang
  WHEN 2 THEN 'label: GREEN' || chr(13) || chr(10) || 'confidence: very high' || chr(10) || 'rationale: a: ' || source
  WHEN 3 THEN '- label: 1' || chr(10) || lang
  WHEN 4 THEN 'rationale:' || chr(10) || 'foo ' || CAST(n_chars AS STRING)
  WHEN 5 THEN text
  ELSE '   LABEL:   1  ' || chr(10) || ' confidence:Medium ' || chr(10) || chr(10) || ' Rationale:  n ' || CAST(n_chars AS STRING) || '  ' END AS reply
FROM {documents}"""

REPLIES_JSON = """SELECT doc_id, CASE doc_id % 14
  WHEN 0 THEN '{{"label": 1, "rationale": "' || source || '"}}'
  WHEN 1 THEN 'Sure: {{"label": ' || CAST(n_chars % 2 AS STRING) || ', "rationale": "x"}} done'
  WHEN 2 THEN '"label": 0, "rationale": "' || lang || '"'
  WHEN 3 THEN '{{"label": "1"}}'
  WHEN 4 THEN '{{"label": true, "rationale": "t"}}'
  WHEN 5 THEN '{{"label": 0.9, "rationale": "n ' || CAST(n_chars AS STRING) || '"}}'
  WHEN 6 THEN '{{"label": "1.0"}}'
  WHEN 7 THEN '{{"label": ' || CAST(n_chars AS STRING) || '}}'
  WHEN 8 THEN '{{"label": 2, "rationale": "step 1"}}'
  WHEN 9 THEN '{{"label": 1, "meta": {{"k": 2}}, "rationale": "' || source || '"}}'
  WHEN 10 THEN '{{''label'': 1}}'
  WHEN 11 THEN 'Score 0.5, "label": 1'
  WHEN 12 THEN text
  ELSE '' END AS reply
FROM {documents}"""

REPLIES_JUDGE = """SELECT doc_id, CASE doc_id % 9
  WHEN 0 THEN '{{"label": ' || CAST(n_chars % 2 AS STRING) || ', "confidence": "high", "rationale": "' || source || '"}}'
  WHEN 1 THEN 'So: {{"label": "1", "confidence": "High"}}'
  WHEN 2 THEN '"label": 1, "confidence": "high", "rationale": "of ' || lang || '"'
  WHEN 3 THEN '{{"label": 2, "confidence": "medium", "rationale": "n ' || CAST(n_chars AS STRING) || '"}}'
  WHEN 4 THEN '{{"label": 1, "meta": {{"k": 2}}}}'
  WHEN 5 THEN '{{"label": 0, "rationale": null}}'
  WHEN 6 THEN 'no verdict on ' || source
  WHEN 7 THEN '"label": 0 and nothing more'
  ELSE text END AS judge_json
FROM {documents}"""

# Token vectors of a document, some masked out, every tenth document all masked.
TOKENS = """SELECT CAST(floor(vec_id / 8) AS BIGINT) AS doc_id, embedding AS vec,
  CASE WHEN CAST(floor(vec_id / 8) AS BIGINT) % 10 = 9 OR vec_id % 3 = 0 THEN 0 ELSE 1 END AS mask FROM {embeddings}"""

SENTENCES = """SELECT CAST(floor(vec_id / 8) AS BIGINT) AS sentence, vec_id % 8 AS pos, embedding AS vec FROM {embeddings}"""

SAMPLES = """SELECT l_suppkey AS supp, l_orderkey * 8 + l_linenumber AS pos, l_quantity AS x,
  l_extendedprice / CAST(1000 AS DOUBLE) AS t FROM {lineitem}"""

# One row per user, one 0/1 column per event type; two types are the positive ones.
CLAIMS_WIDE = """SELECT user_id AS id,
  max(CASE WHEN event_type = 'purchase' AND value > 200 THEN 1 ELSE 0 END) AS Y02_purchase,
  max(CASE WHEN event_type = 'signup' THEN CASE WHEN value > 200 THEN 1 ELSE 0 END END) AS Y02_signup,
  max(CASE WHEN event_type = 'click' AND value > 200 THEN 1 ELSE 0 END) AS X_click,
  max(CASE WHEN event_type = 'view' AND value > 200 THEN 1 ELSE 0 END) AS X_view,
  max(CASE WHEN event_type = 'error' AND value > 200 THEN 1 ELSE 0 END) AS X_error
FROM {events} GROUP BY user_id"""

# A linear model over 64 dimensions.
WEIGHTS = [((i * 7) % 13 - 6) / 10 for i in range(64)]
INTERCEPT = 0.05
# The same for vectors made of texts, which have 16 slots.
TEXT_WEIGHTS = WEIGHTS[:16]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, select: str) -> DataFrame:
    """A fixture as a DataFrame over the tables in ``sf_dir``."""
    used = [t for t in TABLES if "{" + t + "}" in select]
    return spark.sql(select, **{t: read(spark, sf_dir, t) for t in used})


def sql(select: str) -> str:
    """A fixture as a sub-query over the registered views."""
    return "(" + select.format(**{t: t for t in TABLES}) + ")"
