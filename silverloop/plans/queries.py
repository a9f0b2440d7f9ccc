"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silverloop import contracts
from silverloop.operators import (
    assembly,
    attention,
    classify,
    cleaning,
    fold,
    inference,
    joins,
    metrics,
    sampling,
    text,
    vectors,
)
from silverloop.plans import fixtures as fx
from silverloop.plans import standins, workflows
from silverloop.session import configure, new_path
from silverloop.sources import readers, stores, writers
from silverloop.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir.rstrip("/"))

    QUERIES[fn.__name__] = run
    return fn


def _cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def _tasks(docs) -> int | None:
    """As many tasks as cores for a table of fewer files; else rows stay where they are."""
    cores = _cores(docs.sparkSession)
    return cores if len(docs.inputFiles()) < cores else None


def r6(c: Column) -> Column:
    """Six decimals, never a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def r4(c: Column) -> Column:
    """Four decimals: as far as two solvers of one fit agree."""
    return F.round(c, 4) + F.lit(0.0)


def r6_array(c: Column) -> Column:
    return F.transform(c, r6)


# -- sources, sinks, contracts ------------------------------------------------


@query
def read_table_auto(spark, sf_dir):
    """Parquet, and the same rows again through CSV files."""
    first = readers.read_table_auto(spark, f"{sf_dir}/documents.parquet")
    path = new_path(spark, "documents") + ".CSV"
    writers.write_csv(first, path)
    second = readers.read_table_auto(spark, path, first.schema)
    return first.withColumn("src", F.lit("parquet")).unionByName(second.withColumn("src", F.lit("csv")))


@query
def read_csv_strings(spark, sf_dir):
    path = new_path(spark, "review")
    writers.write_csv(fx.derive(spark, sf_dir, fx.REVIEW_LIST), path)
    return readers.read_csv_strings(spark, path)


@query
def write_splits(spark, sf_dir):
    path = new_path(spark, "splits")
    writers.write_splits(fx.derive(spark, sf_dir, fx.CORPUS), path)
    back = spark.read.parquet(path)
    return cleaning.split_filter(back, "eval_silver").select("id", "text", "is_green_silver", "split")


@query
def write_csv(spark, sf_dir):
    path = new_path(spark, "conversations")
    source = fx.read(spark, sf_dir, "conversations")
    writers.write_csv(source, path)
    return readers.read_table_auto(spark, path + "/*.csv", source.schema)


@query
def embedding_store(spark, sf_dir):
    path = new_path(spark, "embeddings")
    stores.save_embeddings(fx.read(spark, sf_dir, "embeddings"), path, "vec_id", label="label")
    back = stores.load_embeddings(spark, path)
    return back.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


def _fitted(spark, sf_dir):
    data = fx.read(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") < 5).cast("int"))
    return data, classify.fit_logreg(data, label="y")


@query
def model_store(spark, sf_dir):
    data, model = _fitted(spark, sf_dir)
    path = new_path(spark, "model")
    stores.save_model(model, path)
    scored = classify.predict_proba(data, stores.load_model(path))
    return scored.select("vec_id", r4(F.col("p_green")).alias("p_green"), "prediction")


def _predictions(spark, sf_dir):
    return fx.derive(spark, sf_dir, fx.PREDICTIONS)


@query
def metrics_sink(spark, sf_dir):
    path = new_path(spark, "metrics")
    for run in ("first", "second", "first"):  # a run that is written again stands once
        stores.append_metrics(metrics.metric_rows(_predictions(spark, sf_dir), run, p_one="p_true"), path)
    rows = stores.load_metrics(spark, path)
    return rows.select("run", "section", "class", "metric", r6(F.col("value")).alias("value"))


@query
def check_contract(spark, sf_dir):
    reviewed = cleaning.clean_doc_id(fx.derive(spark, sf_dir, fx.REVIEWED), "doc_id")
    return contracts.check_contract(reviewed, ["doc_id", "text", "is_green_human"], "doc_id")


# -- projections, filters, cleaning -------------------------------------------


@query
def select_prefix(spark, sf_dir):
    return cleaning.select_prefix(fx.derive(spark, sf_dir, fx.CLAIMS_WIDE), "Y02", keep=["id"])


@query
def any_positive_label(spark, sf_dir):
    labelled = cleaning.any_positive_label(fx.derive(spark, sf_dir, fx.CLAIMS_WIDE), "Y02")
    return labelled.select("id", "is_green_silver")


@query
def split_filter(spark, sf_dir):
    return cleaning.split_filter(fx.derive(spark, sf_dir, fx.CORPUS_MESSY), "train_silver", normalize=True)


@query
def project_rename(spark, sf_dir):
    corpus = fx.derive(spark, sf_dir, fx.CORPUS)
    return cleaning.project_rename(corpus, {"id": "doc_id", "text": "text", "is_green_silver": "label"})


@query
def coerce_binary(spark, sf_dir):
    corpus = fx.derive(spark, sf_dir, fx.CORPUS).select("id", "text", F.col("is_green_silver").alias("label"))
    return cleaning.coerce_binary(corpus)


@query
def to_int01(spark, sf_dir):
    return cleaning.to_int01(fx.derive(spark, sf_dir, fx.CORPUS), "is_green_silver", "gold01").select(
        "id", "is_green_silver", "gold01"
    )


@query
def clean_doc_id(spark, sf_dir):
    reviewed = fx.derive(spark, sf_dir, fx.REVIEWED)
    return cleaning.clean_doc_id(reviewed, "doc_id", "clean_id").select("doc_id", "source_pos", "clean_id")


@query
def text_or_empty(spark, sf_dir):
    return cleaning.text_or_empty(fx.derive(spark, sf_dir, fx.CORPUS)).select("id", "text")


@query
def drop_incomplete(spark, sf_dir):
    return cleaning.drop_incomplete(fx.derive(spark, sf_dir, fx.CORPUS), ["text", "is_green_silver"])


@query
def ensure_columns(spark, sf_dir):
    rows = fx.derive(spark, sf_dir, fx.REVIEW_LIST).select("doc_id", "llm_confidence")
    defaults = {**dict.fromkeys(cleaning.REVIEW_COLUMNS, ""), "parse_failed": False}
    return cleaning.ensure_columns(rows, defaults)


@query
def pending_filter(spark, sf_dir):
    return cleaning.pending_filter(fx.derive(spark, sf_dir, fx.REVIEW_LIST)).drop("text")


@query
def row_cap(spark, sf_dir):
    """First-n by row position; the position is a column of the table."""
    return cleaning.row_cap(fx.read(spark, sf_dir, "documents").select("doc_id", "text"), 500, "doc_id")


@query
def keep_last_by_file_order(spark, sf_dir):
    """The last document of each language and source as the CSV files stand, and the first 500 of all; no position column is in them."""
    docs = fx.read(spark, sf_dir, "documents")
    path = new_path(spark, "documents") + ".csv"
    writers.write_csv(docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), path)
    read = readers.read_table_auto(spark, path, docs.schema, position="place")
    last = sampling.dedupe_keep_last(read, ["lang", "source"], "place").withColumn("kind", F.lit("last"))
    both = last.unionByName(cleaning.row_cap(read, 500, "place").withColumn("kind", F.lit("first 500")))
    return both.select("kind", "lang", "source", "doc_id", "text")


# -- joins --------------------------------------------------------------------


def _corpus_and_gold(spark, sf_dir):
    return fx.derive(spark, sf_dir, fx.CORPUS), fx.derive(spark, sf_dir, fx.REVIEWED)


@query
def gold_join(spark, sf_dir):
    return joins.gold_join(*_corpus_and_gold(spark, sf_dir)).select("id", "split", "is_green_human")


@query
def gold_override(spark, sf_dir):
    joined = joins.gold_join(*_corpus_and_gold(spark, sf_dir))
    return joins.gold_override(joined).select("id", "split", "is_green_gold")


@query
def gold_matched(spark, sf_dir):
    return joins.gold_matched(joins.gold_join(*_corpus_and_gold(spark, sf_dir))).select("id", "text", "is_green_human")


@query
def exclude_ids(spark, sf_dir):
    return joins.exclude_ids(*_corpus_and_gold(spark, sf_dir))


@query
def complement(spark, sf_dir):
    labels = fx.read(spark, sf_dir, "labels")
    return joins.complement(labels, sampling.cap_sample(labels, 50, "doc_id"), "doc_id")


BUCKETS = 16


@query
def embedding_align(spark, sf_dir):
    """Every document with its vector, null where it has none; both stored in buckets of the id and joined as they lie."""
    paths = new_path(spark, "aligned-documents"), new_path(spark, "aligned-vectors")
    stores.save_bucketed(fx.read(spark, sf_dir, "documents").select("doc_id", "lang"), paths[0], "doc_id", BUCKETS)
    stores.save_embeddings(fx.read(spark, sf_dir, "embeddings"), paths[1], "vec_id", buckets=BUCKETS)
    vecs = stores.load_embeddings(spark, paths[1], bucketed=True)
    aligned = joins.embedding_align(stores.load_bucketed(spark, paths[0]), vecs, "doc_id", "vec_id", on_missing="null")
    return aligned.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))


@query
def token_lookup(spark, sf_dir):
    """Every token of every turn with the vector of its word."""
    turns = fx.read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.tokens_of(F.col("text")).alias("tokens")
    )
    words = turns.select(F.explode("tokens").alias("word")).distinct()
    without_e = F.length(F.replace(F.col("word"), F.lit("e"), F.lit("")))
    dictionary = words.withColumn("vec", F.array(F.length("word").cast("double"), without_e.cast("double")))
    return joins.token_lookup(turns, dictionary)


# -- aggregations -------------------------------------------------------------


@query
def label_counts(spark, sf_dir):
    return metrics.label_counts(fx.derive(spark, sf_dir, fx.CORPUS), "is_green_silver")


@query
def split_distribution(spark, sf_dir):
    return metrics.split_distribution(fx.derive(spark, sf_dir, fx.CORPUS_MESSY))


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_predictions(spark, sf_dir))


@query
def prf_binary(spark, sf_dir):
    row = metrics.prf_binary(_predictions(spark, sf_dir))
    return row.select("n", *[r6(F.col(m)).alias(m) for m in ("accuracy", "precision", "recall", "f1")])


@query
def classification_report(spark, sf_dir):
    return metrics.classification_report(_predictions(spark, sf_dir))


@query
def log_loss(spark, sf_dir):
    return metrics.log_loss(_predictions(spark, sf_dir)).select(r6(F.col("log_loss")).alias("log_loss"))


@query
def run_summary(spark, sf_dir):
    row = metrics.run_summary(text.judge_columns(fx.derive(spark, sf_dir, fx.REPLIES_JUDGE)))
    return row.withColumn("failed_rate", r6(F.col("failed_rate")))


@query
def parse_quality(spark, sf_dir):
    return metrics.parse_quality(text.resolve_label(fx.derive(spark, sf_dir, fx.REPLIES_JSON)))


# -- ranking, samples, splits -------------------------------------------------


@query
def dedupe_keep_last(spark, sf_dir):
    reviewed = cleaning.clean_doc_id(fx.derive(spark, sf_dir, fx.REVIEWED), "doc_id")
    return sampling.dedupe_keep_last(reviewed, "doc_id", "source_pos")


def _scored_vectors(spark, sf_dir):
    scored = vectors.linear_score(fx.read(spark, sf_dir, "embeddings"), fx.WEIGHTS, fx.INTERCEPT)
    return vectors.uncertainty(scored)


@query
def top_uncertain(spark, sf_dir):
    top = sampling.top_uncertain(_scored_vectors(spark, sf_dir), 100, tie="vec_id")
    return top.select("vec_id", r6(F.col("u")).alias("u"))


@query
def class_sample(spark, sf_dir):
    return sampling.class_sample(fx.read(spark, sf_dir, "labels"), "quality", 10, "doc_id")


@query
def seeded_shuffle(spark, sf_dir):
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.seeded_shuffle(docs, "doc_id")


@query
def cap_sample(spark, sf_dir):
    return sampling.cap_sample(fx.read(spark, sf_dir, "documents").select("doc_id", "text"), 300, "doc_id")


@query
def split_60_20_20(spark, sf_dir):
    return sampling.split_60_20_20(fx.read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


@query
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(fx.read(spark, sf_dir, "labels"), "quality", "doc_id")


# -- training sets ------------------------------------------------------------


@query
def union_all(spark, sf_dir):
    docs = fx.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    bench = fx.read(spark, sf_dir, "benchmark").select("text", F.col("item_id").alias("id"))
    return assembly.union_all(docs, bench)


@query
def augment_replace(spark, sf_dir):
    return assembly.augment_replace(*_corpus_and_gold(spark, sf_dir))


@query
def augment_append(spark, sf_dir):
    return assembly.augment_append(*_corpus_and_gold(spark, sf_dir), label="is_green_human")


# -- text and replies ---------------------------------------------------------


@query
def render_prompt(spark, sf_dir):
    """All five templates for every document."""
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    slots = {"claim": "text"}
    out = text.render_prompt(docs, "labeller", "labeller", **slots)
    out = text.render_prompt(out, "advocate", "advocate", **slots)
    out = text.render_prompt(out, "skeptic", "skeptic", **slots)
    out = text.render_prompt(out, "judge", "judge", **slots, advocate="lang", skeptic="source")
    out = text.render_prompt(out, "classifier", "classifier", **slots)
    return out.select("doc_id", "labeller", "advocate", "skeptic", "judge", "classifier")


@query
def chat_render(spark, sf_dir):
    return text.chat_render(text.collect_messages(fx.read(spark, sf_dir, "conversations")))


@query
def sft_target(spark, sf_dir):
    corpus = cleaning.to_int01(fx.derive(spark, sf_dir, fx.CORPUS), "is_green_silver", "label01")
    return text.sft_target(cleaning.drop_incomplete(corpus, ["label01"])).select("id", "target")


@query
def sft_records(spark, sf_dir):
    return text.sft_records(
        fx.derive(spark, sf_dir, fx.CORPUS_MESSY), fx.derive(spark, sf_dir, fx.REVIEWED)
    )


@query
def parse_kv_response(spark, sf_dir):
    return text.parse_kv_response(fx.derive(spark, sf_dir, fx.REPLIES_KV)).drop("reply")


@query
def json_first_object(spark, sf_dir):
    parsed = text.json_first_object(fx.derive(spark, sf_dir, fx.REPLIES_JSON))
    return parsed.select(
        "doc_id",
        F.col("obj").isNotNull().alias("parsed"),
        F.try_variant_get("obj", "$.label", "string").alias("label"),
        F.try_variant_get("obj", "$.rationale", "string").alias("rationale"),
    )


@query
def label_fallback(spark, sf_dir):
    return text.label_fallback(fx.derive(spark, sf_dir, fx.REPLIES_JSON)).select("doc_id", "label")


@query
def resolve_label(spark, sf_dir):
    return text.resolve_label(fx.derive(spark, sf_dir, fx.REPLIES_JSON)).drop("reply")


@query
def salvage_json(spark, sf_dir):
    parsed = text.salvage_json(fx.derive(spark, sf_dir, fx.REPLIES_JUDGE), "judge_json")
    fields = [F.try_variant_get("obj", f"$.{f}", "string").alias(f) for f in ("label", "confidence", "rationale")]
    return parsed.select("doc_id", F.col("obj").isNotNull().alias("parsed"), *fields)


@query
def judge_columns(spark, sf_dir):
    return text.judge_columns(fx.derive(spark, sf_dir, fx.REPLIES_JUDGE)).drop("judge_json")


@query
def token_truncate(spark, sf_dir):
    docs = text.token_truncate(fx.read(spark, sf_dir, "documents"), text.MAX_TOKENS["encoder"])
    return docs.select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.array_join("tokens", " ").alias("text"))


@query
def sequence_pack(spark, sf_dir):
    return text.sequence_pack(fx.read(spark, sf_dir, "documents"), "doc_id", text.MAX_TOKENS["pack"])


# -- vectors, classifier, attention, fold -------------------------------------


@query
def uncertainty(spark, sf_dir):
    return vectors.uncertainty(_predictions(spark, sf_dir), "p_true").select("doc_id", r6(F.col("u")).alias("u"))


@query
def masked_mean_pool(spark, sf_dir):
    pooled = vectors.masked_mean_pool(fx.derive(spark, sf_dir, fx.TOKENS))
    return pooled.select("doc_id", r6_array(F.col("pooled")).alias("pooled"))


@query
def embed_batches(spark, sf_dir):
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "text")
    rounded = F.transform("embedding", lambda x: F.round(x.cast("float").cast("double"), 5))
    return _embedded(docs).select("doc_id", rounded.alias("embedding"))


def _embedded(docs):
    """Whole texts by an encoder of 256 tokens."""
    encoder = lambda: classify.hashed_mean_encoder(dim=16, max_tokens=256)
    return classify.embed_documents(docs, encoder, tasks=_tasks(docs))


@query
def fit_logreg(spark, sf_dir):
    """The fitted coefficients, one row each; the intercept has index -1."""
    data, model = _fitted(spark, sf_dir)
    fitted = model.stages[-1]
    values = [(-1, float(fitted.intercept))] + [(i, float(c)) for i, c in enumerate(fitted.coefficients)]
    return spark.createDataFrame(values, "idx int, value double").select("idx", r4(F.col("value")).alias("value"))


@query
def predict_proba(spark, sf_dir):
    data, model = _fitted(spark, sf_dir)
    scored = classify.predict_proba(data, model)
    return scored.select("vec_id", "y", r4(F.col("p_green")).alias("p_green"), "prediction")


@query
def linear_score(spark, sf_dir):
    scored = vectors.linear_score(fx.read(spark, sf_dir, "embeddings"), fx.WEIGHTS, fx.INTERCEPT)
    return scored.select("vec_id", r6(F.col("p_green")).alias("p_green"), "prediction")


@query
def argmax_label(spark, sf_dir):
    vecs = fx.read(spark, sf_dir, "embeddings")
    return vectors.argmax_label(vecs, "embedding", "best").select("vec_id", "best")


RETRAIN_DIM = 16


def _metrics_of(fitted):
    """Metric rows to as many decimals as two solvers of one fit agree."""
    return fitted[1].withColumn("value", r4(F.col("value")))


def _retrained(spark):
    return {"make_encoder": lambda: classify.hashed_mean_encoder(dim=RETRAIN_DIM), "tasks": _cores(spark)}


@query
def retrain_eval(spark, sf_dir):
    """Silver labels replaced by reviewed ones; metric rows on the evaluation split."""
    return _metrics_of(workflows.replace_round(*_corpus_and_gold(spark, sf_dir), "replace", **_retrained(spark)))


@query
def retrain_eval_append(spark, sf_dir):
    """Reviewed rows added to the silver ones."""
    return _metrics_of(workflows.append_round(*_corpus_and_gold(spark, sf_dir), "is_green_human", "append", **_retrained(spark)))


@query
def retrain_eval_stratified(spark, sf_dir):
    """Train and test on the reviewed rows alone."""
    _, gold = _corpus_and_gold(spark, sf_dir)
    last = sampling.dedupe_keep_last(cleaning.clean_doc_id(gold, "doc_id"), "doc_id", "source_pos")
    alone = cleaning.coerce_binary(last.select("doc_id", "text", F.col("is_green_human").alias("label")))
    return _metrics_of(workflows.stratified_round(alone, "doc_id", "stratified", **_retrained(spark)))


@query
def attention_scores(spark, sf_dir):
    scores = attention.attention_scores(fx.derive(spark, sf_dir, fx.SENTENCES), block=4)
    return scores.select("sentence", "q_pos", "k_block", r6_array(F.col("scores")).alias("scores"))


@query
def attention_weights(spark, sf_dir):
    weights = attention.attention_weights(fx.derive(spark, sf_dir, fx.SENTENCES), block=4)
    return weights.select("sentence", "q_pos", "k_block", r6_array(F.col("weights")).alias("weights"))


@query
def attention_output(spark, sf_dir):
    out = attention.attention_output(fx.derive(spark, sf_dir, fx.SENTENCES), block=4)
    return out.select("sentence", "pos", r6_array(F.col("context")).alias("context"))


@query
def attention_top(spark, sf_dir):
    """The three keys that each token attends to most."""
    top = attention.attention_top(fx.derive(spark, sf_dir, fx.SENTENCES), 3, block=2)
    return top.select("sentence", "q_pos", "rank", "k_pos", r6(F.col("score")).alias("score"), r6(F.col("weight")).alias("weight"))


@query
def attention_append(spark, sf_dir):
    """Context vectors, and the first token of the next sentence added as it is."""
    tokens = fx.derive(spark, sf_dir, fx.SENTENCES)
    extra = tokens.where((F.col("pos") == 0) & (F.col("sentence") > 0)).select(
        (F.col("sentence") - 1).alias("sentence"), F.lit(8).cast("bigint").alias("pos"), "vec"
    )
    out = attention.attention_append(attention.attention_output(tokens), extra)
    return out.select("sentence", "pos", r6_array(F.col("context")).alias("context"))


@query
def sgd_trace(spark, sf_dir):
    """The whole of every supplier's sequence, in order."""
    trace = fold.sgd_trace(fx.derive(spark, sf_dir, fx.SAMPLES), "supp", "pos")
    values = [F.round(c, 4).alias(c) for c in ("w_old", "prediction", "loss", "gradient", "w_new")]
    return trace.select("supp", "pos", "x", *values)


# -- batch inference, incremental runs, user functions ------------------------


@query
def batch_generate(spark, sf_dir):
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "text").repartition(_cores(spark))
    asked = text.render_prompt(docs, "labeller", claim="text").drop("text")
    return inference.batch_generate(asked, standins.kv_model).select("doc_id", "reply")


@query
def debate(spark, sf_dir):
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "text")
    models = {
        "advocate": standins.argument_model("advocate"),
        "skeptic": standins.argument_model("skeptic"),
        "judge": standins.judge_model,
    }
    return inference.debate(docs, models, tasks=_cores(spark)).drop("text")


@query
def label_incremental(spark, sf_dir):
    """Documents read as a stream, labelled to the end, then run once more: nothing is redone."""
    schema = fx.read(spark, sf_dir, "documents").schema
    sink, checkpoint = new_path(spark, "labelled"), new_path(spark, "labelled-progress")
    for _ in range(2):
        # as a pattern, the path may be one file or a folder of them
        stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]").select("doc_id", "text")
        incremental.label_incremental(stream, standins.kv_model, sink, checkpoint).awaitTermination()
    return spark.read.parquet(sink).select("doc_id", "llm_green_suggested", "llm_confidence", "llm_rationale")


@query
def label_incremental_batch(spark, sf_dir):
    """The same without a stream: half of the documents, then all; nothing is redone."""
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "text")
    sink = new_path(spark, "labelled")
    for rows in (docs.where("doc_id % 2 = 0"), docs):
        incremental.label_incremental_batch(rows, standins.kv_model, sink)
    return spark.read.parquet(sink).select("doc_id", "llm_green_suggested", "llm_confidence", "llm_rationale")


@query
def exclude_eval_gold(spark, sf_dir):
    corpus, gold = _corpus_and_gold(spark, sf_dir)
    return assembly.eval_rows(corpus, gold=gold, exclude_eval_gold=True)


@query
def eval_gold_overlap(spark, sf_dir):
    return assembly.eval_gold_overlap(*_corpus_and_gold(spark, sf_dir))


def _evaluated(spark, sf_dir):
    corpus = fx.derive(spark, sf_dir, fx.CORPUS)
    return inference.evaluate_capped(corpus, standins.json_model)


@query
def evaluate_capped(spark, sf_dir):
    return _evaluated(spark, sf_dir)


@query
def evaluate_capped_report(spark, sf_dir):
    return metrics.classification_report(_evaluated(spark, sf_dir))


def _answered(spark, sf_dir):
    reviewed = fx.derive(spark, sf_dir, fx.REVIEWED).select("source_pos", "text", "is_green_human")
    return inference.predict_and_score(reviewed, standins.json_model)


@query
def predict_and_score(spark, sf_dir):
    return _answered(spark, sf_dir).drop("text")


@query
def predict_and_score_metrics(spark, sf_dir):
    row = metrics.prf_binary(inference.scored_rows(_answered(spark, sf_dir)))
    return row.select("n", *[r6(F.col(m)).alias(m) for m in ("accuracy", "precision", "recall", "f1")])


@query
def map_batches(spark, sf_dir):
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")

    def measure(frame):
        return frame.assign(n=frame["text"].str.len(), lang=frame["lang"].str.upper())[["doc_id", "lang", "n"]]

    return inference.map_batches(docs, measure, "doc_id bigint, lang string, n bigint")


@query
def map_column(spark, sf_dir):
    """Words and vowels of every document, by column functions that are set up once per task."""

    def words():
        word = re.compile(r"[^ \t\n\r\f\v]+")
        return lambda texts: texts.map(lambda t: len(word.findall(t or "")))

    def vowels():
        found = frozenset("aeiou")
        return lambda texts, langs: texts.map(lambda t: sum(t.count(v) for v in found) if t else 0) + langs.str.len().fillna(0)

    n_words, n_vowels = inference.map_column(words, "bigint"), inference.map_columns(vowels, "bigint")
    docs = fx.read(spark, sf_dir, "documents")
    return docs.select("doc_id", n_words("text").alias("n_words"), n_vowels("text", "lang").alias("n_vowels"))


@query
def review_list(spark, sf_dir):
    """The flagship: the 100 unlabelled documents the model is least sure of."""
    documents = fx.read(spark, sf_dir, "documents")
    pool = workflows.unlabelled(documents.select("doc_id", "text"), fx.read(spark, sf_dir, "labels"))
    listed = workflows.review_list(
        pool.select("doc_id"), _embedded(pool), (fx.TEXT_WEIGHTS, fx.INTERCEPT), key="doc_id", vector_key="doc_id", texts=documents
    )
    return listed.withColumns({"p_green": r6(F.col("p_green")), "u": r6(F.col("u"))})


@query
def silver_corpus(spark, sf_dir):
    """Indicator columns to a balanced, split working table."""
    wide = fx.derive(spark, sf_dir, fx.CLAIMS_WIDE)
    return workflows.silver_corpus(wide, "Y02", 7).select("id", "is_green_silver", "split")
