"""Cases that once gave wrong, missing or slow results."""

from __future__ import annotations

import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from silverloop.operators import classify, inference, joins, sampling, text
from silverloop.plans import standins
from silverloop.streaming import incremental


def test_null_positions_lose_no_row(spark):
    df = spark.createDataFrame([("a", "x", None), ("a", "y", None), ("b", "z", 1), ("b", "w", None)], "k string, v string, p int")
    got = {r.k: (r.v, r.p) for r in sampling.dedupe_keep_last(df, "k", "p").collect()}
    assert got["a"][0] in ("x", "y") and got["a"][1] is None and got["b"] == ("z", 1)
    again = {r.k: (r.v, r.p) for r in sampling.dedupe_keep_last(df.repartition(3), "k", "p").collect()}
    assert again == got


@pytest.mark.parametrize("kind", ["double", "int", "string"])
def test_class_sample_and_split_by_value_of_any_type(spark, kind):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 2).cast("int").cast(kind).alias("y"))
    classes = ("0", "1") if kind == "string" else (0, 1)
    assert sampling.class_sample(df, "y", 10, "id", classes=classes).count() == 20
    parts = sampling.stratified_split(df, "y", "id", classes=classes).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"train": 85, "test": 15}


def test_stratified_split_keeps_rows_of_other_classes(spark):
    df = spark.range(99).select("id", F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 3).cast("int").alias("y"))
    out = sampling.stratified_split(df, "y", "id")
    assert out.count() == 99
    assert out.where("part IS NULL").count() == df.where("y IS NULL OR y = 2").count()


def test_null_parts_of_a_key_have_their_own_place(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "a string, b string")
    assert df.select(sampling.seeded_key(1, ["a", "b"])).distinct().count() == 2


def test_streamed_null_keys_fail_and_copies_are_labelled_once(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id long, text string")
    got = incremental.label_new(rows, standins.kv_model, "doc_id", "text", None).collect()
    again = incremental.label_new(rows.repartition(3), standins.kv_model, "doc_id", "text", None).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((r.doc_id, r.text) for r in again) and len(got) == 2
    assert all(r.llm_raw for r in got)
    with pytest.raises(PySparkException):
        incremental.label_new(rows.union(spark.createDataFrame([(None, "d")], rows.schema)), standins.kv_model, "doc_id", "text", None).collect()


@pytest.mark.parametrize("reply", [" " * 500_000 + "x" + " " * 500_000, "{" * 1_000_000, "a" + "\n" * 1_000_000 + "b", "a" + " " * 1_000_000 + "b"])
def test_long_replies_are_read_in_linear_time(spark, reply):
    df = spark.createDataFrame([(reply,)], "reply string")
    text.resolve_label(spark.createDataFrame([("x",)], "reply string")).collect()
    begin = time.time()
    text.resolve_label(df).select("label", "rationale", "ok").collect()
    text.parse_kv_response(df).select("label", "confidence").collect()
    text.judge_columns(df.withColumnRenamed("reply", "judge_json")).select("llm_green_suggested").collect()
    assert time.time() - begin < 20


def _counting(spark, make):
    calls = spark.sparkContext.accumulator(0)

    def made():
        ask = make()

        def generate(prompts):
            calls.add(len(prompts))
            return ask(prompts)

        return generate

    return made, calls


def test_answers_are_generated_once_for_all_readers(spark):
    rows = spark.range(40).select("id", F.concat(F.lit("t"), "id").alias("text"), (F.col("id") % 2).cast("string").alias("is_green_human"))
    model, calls = _counting(spark, standins.json_model)
    answered = inference.predict_and_score(rows, model)
    answered.count()
    inference.scored_rows(answered).collect()
    answered.groupBy("qlora_json_ok").count().collect()
    assert calls.value == 40
    model, calls = _counting(spark, standins.json_model)
    evaluated = inference.evaluate_capped(rows, model, gold="is_green_human")
    assert evaluated.count() == 40 and evaluated.where("ok").count() >= 0 and calls.value == 40


def test_a_debate_goes_on_where_it_stopped(spark, tmp_path):
    rows = spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    models, counts = {}, {}
    for role, make in {"advocate": standins.argument_model("advocate"), "skeptic": standins.argument_model("skeptic"), "judge": standins.judge_model}.items():
        models[role], counts[role] = _counting(spark, make)
    run = str(tmp_path / "run")
    first = inference.debate(rows.where("doc_id < 20"), models, run=run, tasks=3)
    assert first.count() == 20 and {c.value for c in counts.values()} == {20}
    whole = inference.debate(rows, models, run=run, tasks=3)
    assert whole.count() == 30 and {c.value for c in counts.values()} == {30}


def test_embeddings_read_whole_texts(spark):
    df = spark.createDataFrame([(1, "a " * 300 + "b " * 300), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.embedding for r in classify.embed_documents(df, lambda: classify.hashed_mean_encoder(8, 256)).collect()}
    whole = {r.doc_id: r.embedding for r in classify.embed_batches(df, lambda: classify.hashed_mean_encoder(8)).collect()}
    assert got[1] == pytest.approx(whole[1], abs=1e-6) and got[2] == got[3] == [0.0] * 8


def test_vectors_are_joined_and_not_grouped(spark):
    df = spark.range(3).withColumnRenamed("id", "k")
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], "id long, embedding array<double>")
    out = joins.embedding_align(df, vectors, "k")
    assert sorted(r.embedding[0] for r in out.collect()) == [1.0, 2.0, 3.0]
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(PySparkException, match="more than one vector"):
        joins.embedding_align(df, vectors.union(vectors), "k").collect()


def test_a_conversation_is_one_row(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(200)], "conv_id long, turn long, role string, text string")
    rows = text.chat_render(text.collect_messages(turns)).collect()
    assert len(rows) == 1 and rows[0].chat.count("[INST]") == 100
