"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from silverloop.llm import alignment, decontaminate, fingerprint, htmltext, langid, minhash, periods, pieces, simhash, substrings, tokenfiles, toolcalls, warczip
from silverloop.llm.common import read, shared_path, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from those outside the held-out quarter."""
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs.where(~_held_out()))
    return langid.predict(docs, model).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


@query
def op9_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    found = simhash.classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to."""
    vocabulary = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    found = pieces.encode_and_decode(read(spark, sf_dir, "documents"), vocabulary)
    ids_sha256 = F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256")
    decoded = F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("decoded_sha256")
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), ids_sha256, *decoded)


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's ids, from the files."""
    folder = shared_path(spark, "token-files")
    shards = tokenfiles.write(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    found = tokenfiles.read(spark, shards)
    n_tokens = F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens")
    return found.select(F.col("key").alias("doc_id"), "start", n_tokens, F.crc32("ids").alias("ids_crc32"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark window, and whose they are."""
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a repeated window of 35 words covers go."""
    found = substrings.repeated_words(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = htmltext.extract(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query
def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, from packages written and read back."""
    paths = warczip.write(read(spark, sf_dir, "pages"), shared_path(spark, "warc-zip"))
    return warczip.read(spark, paths).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op7_warc_zip"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
"""


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are."""
    return fingerprint.fingerprints(read(spark, sf_dir, "documents"))


def _hash_sql(d: str, table: int) -> str:
    a, c, b = fingerprint.constants(table, 0)
    return f"((({d} % {fingerprint.PRIME}) * {a} + ({d} >> 31) * {c} + {b}) % {fingerprint.PRIME})"


_CELL_SQL = ", ".join(f"{_hash_sql('d', t)} % {fingerprint.CELLS} + {fingerprint.CELLS * t}" for t in range(fingerprint.TABLES))
ORACLES["op2_fingerprints"] = f"""
WITH o AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS k FROM documents
), e AS (
  SELECT a.doc_id, a.r, a.t, b.r AS nr, length(a.t) AS n_chars,
    substr(a.t, 1, length(a.t) - length(a.t) // 4) || substr(b.t, 1, length(a.t) // 4) AS ed
  FROM o a JOIN o b ON b.r = a.r % a.k + 1
), u AS (
  SELECT r, v, ('0x' || substr(md5(x), 1, 10))::BIGINT AS d
  FROM (SELECT r, 0 AS v, unnest(regexp_extract_all(t, '{fingerprint.UNITS}')) AS x FROM e
        UNION ALL SELECT r, 1, unnest(regexp_extract_all(ed, '{fingerprint.UNITS}')) FROM e)
), s AS (
  SELECT r, v, cell, count(*) AS n, sum(d) AS k, sum(g) AS c
  FROM (SELECT r, v, d, {_hash_sql('d', -1)} AS g, unnest([{_CELL_SQL}]) AS cell FROM u) GROUP BY r, v, cell
), f AS (
  SELECT r, v, string_agg(concat_ws('.', cell, n, k, c), ',' ORDER BY cell) AS cells FROM s GROUP BY r, v
), m AS (SELECT r, v, d, count(*) AS n FROM u GROUP BY r, v, d),
c AS (SELECT r, v, sum(n) AS n FROM m GROUP BY r, v),
shared AS (
  SELECT e.r, sum(least(a.n, b.n)) FILTER (b.v = 1) AS s1, sum(least(a.n, b.n)) FILTER (b.v = 0) AS s2
  FROM e JOIN m a ON a.r = e.r AND a.v = 0
  JOIN m b ON b.d = a.d AND ((b.v = 1 AND b.r = e.r) OR (b.v = 0 AND b.r = e.nr)) GROUP BY e.r
)
SELECT doc_id, n_chars, sha256(ed) AS edited_sha256,
  coalesce(c0.n, 0) || ';' || coalesce(f0.cells, '') AS fingerprint,
  coalesce(c1.n, 0) || ';' || coalesce(f1.cells, '') AS edited_fingerprint,
  CASE WHEN coalesce(c0.n, 0) + coalesce(c1.n, 0) = 0 THEN 1.0::DOUBLE
    ELSE (2 * coalesce(s1, 0))::DOUBLE / (coalesce(c0.n, 0) + coalesce(c1.n, 0))::DOUBLE END AS near_edited,
  CASE WHEN coalesce(c0.n, 0) + coalesce(c2.n, 0) = 0 THEN 1.0::DOUBLE
    ELSE (2 * coalesce(s2, 0))::DOUBLE / (coalesce(c0.n, 0) + coalesce(c2.n, 0))::DOUBLE END AS near_next
FROM e LEFT JOIN f f0 ON f0.r = e.r AND f0.v = 0 LEFT JOIN f f1 ON f1.r = e.r AND f1.v = 1
LEFT JOIN c c0 ON c0.r = e.r AND c0.v = 0 LEFT JOIN c c1 ON c1.r = e.r AND c1.v = 1
LEFT JOIN c c2 ON c2.r = e.nr AND c2.v = 0 LEFT JOIN shared ON shared.r = e.r
"""


TOOLS = {
    "search": {
        "type": "object",
        "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}, "order": {"type": "string", "enum": ["new", "old"]}},
        "required": ["query", "limit"],
        "additionalProperties": False,
    },
    "configure": {"type": "object", "properties": {"text": {"type": "string"}, "strict": {"type": "boolean"}}, "required": ["text", "strict"]},
}


@query
def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls made of all turns: a user's is a search that the turn after it answers and that follows the
    user's last; a system's configures, once the first search is done."""
    turns = read(spark, sf_dir, "conversations")
    asked = turns.where("role IN ('user', 'system')")
    name = F.when(F.col("role") == "user", F.lit("search")).otherwise(F.lit("configure"))
    limit = F.length("text").cast("bigint")
    search = F.to_json(F.struct(F.col("text").alias("query"), limit.alias("limit"), F.when(limit % 2 == 0, F.lit("new")).otherwise(F.lit("any")).alias("order")))
    configure = F.to_json(F.struct(F.col("text").alias("text"), F.lit("yes").alias("strict")))
    after = F.when(F.col("role") == "system", F.col("turn") + 1).otherwise(F.when(F.col("turn") > 1, F.col("turn") - 2))
    calls = asked.select(
        "conv_id", F.concat(F.lit("c"), "turn").alias("call_id"), "turn", name.alias("name"), F.when(F.col("role") == "user", search).otherwise(configure).alias("arguments"), F.array(F.concat(F.lit("c"), after)).alias("after")
    )
    results = turns.where("role = 'assistant'").select("conv_id", F.concat(F.lit("c"), F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    found = toolcalls.link(calls, results, TOOLS)
    return found.withColumn("errors", F.array_join("errors", "; "))


ORACLES["op10_tool_calls"] = """
WITH a AS (
  SELECT conv_id, turn, role, text, 'c' || turn AS id,
    CASE WHEN role = 'system' THEN turn + 1 WHEN turn > 1 THEN turn - 2 END AS dep, length(text) AS n
  FROM conversations WHERE role IN ('user', 'system')
), r AS (SELECT conv_id, 'c' || (turn - 1) AS id, text FROM conversations WHERE role = 'assistant'),
j AS (
  SELECT a.*, r.text AS result, b.turn AS on_turn
  FROM a LEFT JOIN r ON r.conv_id = a.conv_id AND r.id = a.id
  LEFT JOIN a b ON b.conv_id = a.conv_id AND b.turn = a.dep
)
SELECT conv_id, id AS call_id, turn, CASE role WHEN 'user' THEN 'search' ELSE 'configure' END AS name,
  greatest(turn, coalesce(on_turn, turn)) AS ready, CASE WHEN on_turn > turn THEN 1 ELSE 0 END AS depth,
  CASE WHEN result IS NULL THEN 0 ELSE 1 END AS n_results,
  concat_ws('; ', CASE WHEN role = 'system' THEN 'strict: not boolean' WHEN n % 2 = 1 THEN 'order: not in enum' END,
    CASE WHEN dep IS NOT NULL AND on_turn IS NULL THEN 'after: unknown c' || dep END,
    CASE WHEN result IS NULL THEN 'no result' END) AS errors,
  '{"arguments":' || CASE role
      WHEN 'user' THEN '{"limit":' || n || ',"order":"' || CASE WHEN n % 2 = 0 THEN 'new' ELSE 'any' END || '","query":' || to_json(text) || '}'
      ELSE '{"strict":"yes","text":' || to_json(text) || '}' END
    || ',"id":"' || id || '","name":"' || CASE role WHEN 'user' THEN 'search' ELSE 'configure' END
    || '","result":' || coalesce(to_json(result), 'null') || '}' AS line
FROM j
"""


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two public tokenizers lie on every document, and how usual its links are."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = alignment.align(read(spark, sf_dir, "documents"), *paths)
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    kept = stage(aligned.select("doc_id", "n_a", "n_b", F.size("links").cast("bigint").alias("n_groups"), digest, "links"), "alignment")
    return alignment.weigh(kept, *paths).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _with_tails(docs: DataFrame) -> DataFrame:
    """Documents whose crc32 of the id is a multiple of 10 get a periodic tail, as the query's contract says."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def tailed(words):
        n = F.size(words).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")
        place = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(place, " ")).otherwise(F.lit(""))

    # the array of one binds the words once; else every place would split the text anew
    split = F.transform(F.array(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))), tailed)
    return docs.select("doc_id", F.when(h % 10 == 0, F.get(split, F.lit(0))).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, the steepest one, and the text without their repeats."""
    found = periods.periodic_runs(_with_tails(read(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    top = found.withColumn("top", periods.steepest(F.col("runs")))
    exponent = F.expr("1000 * top.length div top.period").alias("exponent_milli")
    digests = F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    return top.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "top.start", "top.length", "top.period", exponent, *digests)


@query
def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document by shingles of three words."""
    found = minhash.classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
