import pytest
from pyspark.sql import functions as F

from silverloop.operators import classify, inference, metrics
from silverloop.plans import standins
from silverloop.streaming import incremental

DOCS = [(i, f"claim {'x' * i}") for i in range(25)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id int, text string").repartition(4)


def counting_model(log):
    """The key-value stand-in, writing a line per prompt to a file."""

    def make():
        answer = standins.kv_model()

        def generate(prompts):
            with open(log, "a") as f:
                f.writelines(f"{len(p)}\n" for p in prompts)
            return answer(prompts)

        return generate

    return make


def calls(log):
    return len(log.read_text().splitlines()) if log.exists() else 0


def test_batch_generate_cuts_the_echo(docs):
    echo = lambda: lambda prompts: [p + "  reply \n" for p in prompts]
    got = inference.batch_generate(docs, echo, "text", batch=3)
    assert {r.reply for r in got.collect()} == {"reply"} and got.columns == ["doc_id", "text", "reply"]


def test_a_model_that_loses_replies_fails(docs):
    with pytest.raises(Exception, match="shorter"):
        inference.batch_generate(docs, lambda: lambda prompts: [], "text").collect()


def test_embed_batches_loads_once_per_task(docs, tmp_path):
    log = tmp_path / "loads"

    def make():
        with open(log, "a") as f:
            f.write("x\n")
        return lambda texts: [[float(len(t)), float(len(texts))] for t in texts]

    got = classify.embed_batches(docs, make, batch=2).collect()
    assert {r.doc_id: r.embedding[0] for r in got} == {i: float(len(t)) for i, t in DOCS}
    assert max(r.embedding[1] for r in got) <= 2
    assert calls(log) <= docs.rdd.getNumPartitions()


def test_hashed_encoder():
    encode = classify.hashed_mean_encoder(dim=4, max_tokens=2)
    a, b, empty = encode(["x y z", "x\ty", "  "])
    assert a.sum() == pytest.approx(1) and (a == b).all() and (empty == 0).all()


def test_debate_generates_every_reply_once(docs, tmp_path):
    logs = {role: tmp_path / role for role in ("advocate", "skeptic", "judge")}

    def counted(role, make):
        log = str(logs[role])

        def build():
            answer = make()

            def generate(prompts):
                with open(log, "a") as f:
                    f.writelines("x\n" for _ in prompts)
                return answer(prompts)

            return generate

        return build

    models = {
        "advocate": counted("advocate", standins.argument_model("advocate")),
        "skeptic": counted("skeptic", standins.argument_model("skeptic")),
        "judge": counted("judge", standins.judge_model),
    }
    out = inference.debate(docs, models)
    assert out.count() == 25 and metrics.run_summary(out).first().total == 25
    out.collect()
    assert [calls(log) for log in logs.values()] == [25, 25, 25]
    row = out.orderBy("doc_id").first()
    assert row.agent1_advocate.startswith("advocate sees") and row.agent2_skeptic.startswith("skeptic sees")


def test_scoring_policies(spark):
    rows = [(i, "t" * i, "yes") for i in range(1, 9)]
    df = spark.createDataFrame(rows, "id int, text string, is_green_silver string")
    zero = inference.evaluate_capped(df, standins.json_model).collect()
    assert all(r.y_pred is not None for r in zero) and any(r.label is None for r in zero)
    kept = inference.predict_and_score(df.withColumnRenamed("is_green_silver", "is_green_human"), standins.json_model)
    assert kept.where("qlora_label IS NULL").count() == 2
    assert inference.scored_rows(kept).count() == 6
    with pytest.raises(ValueError, match="on_unparsed"):
        inference.evaluate_capped(df, standins.json_model, on_unparsed="one")


def test_map_batches(docs):
    got = inference.map_batches(docs, lambda f: f.assign(n=f["text"].str.len())[["doc_id", "n"]], "doc_id int, n bigint")
    assert {r.doc_id: r.n for r in got.collect()} == {i: len(t) for i, t in DOCS}


def run_stream(spark, source, model, sink, checkpoint):
    stream = spark.readStream.schema("doc_id int, text string").parquet(source)
    incremental.label_incremental(stream, model, sink, checkpoint).awaitTermination()


def test_stream_labels_each_row_once_over_restarts(spark, docs, tmp_path):
    log, source = tmp_path / "log", str(tmp_path / "in")
    sink, checkpoint = str(tmp_path / "out"), str(tmp_path / "progress")
    model = counting_model(str(log))
    docs.where("doc_id < 10").write.parquet(source)
    run_stream(spark, source, model, sink, checkpoint)
    run_stream(spark, source, model, sink, checkpoint)
    assert calls(log) == 10
    # New files: five rows again, five new ones.
    docs.where("doc_id >= 5 AND doc_id < 15").write.mode("append").parquet(source)
    run_stream(spark, source, model, sink, checkpoint)
    assert calls(log) == 15
    got = [r.doc_id for r in spark.read.parquet(sink).collect()]
    assert sorted(got) == list(range(15))


def test_stream_batch_that_fails_is_redone_without_repeats(spark, docs, tmp_path):
    source, sink, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress")
    docs.write.parquet(source)
    flag = tmp_path / "failed"

    def fail_once():
        answer = standins.kv_model()

        def generate(prompts):
            if not flag.exists():
                flag.write_text("x")
                raise RuntimeError("lost")
            return answer(prompts)

        return generate

    with pytest.raises(Exception, match="lost"):
        run_stream(spark, source, fail_once, sink, checkpoint)
    run_stream(spark, source, fail_once, sink, checkpoint)
    assert sorted(r.doc_id for r in spark.read.parquet(sink).collect()) == list(range(25))


def test_replayed_batch_replaces_its_own_folder(spark, docs, tmp_path):
    """The progress of a written batch is lost: it runs again and leaves no row twice."""
    import shutil

    source, sink, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "progress"
    docs.write.parquet(source)
    run_stream(spark, source, standins.kv_model, sink, str(checkpoint))
    shutil.copytree(checkpoint, tmp_path / "progress2", ignore=shutil.ignore_patterns("commits"))
    run_stream(spark, source, standins.kv_model, sink, str(tmp_path / "progress2"))
    assert sorted(r.doc_id for r in spark.read.parquet(sink).collect()) == list(range(25))


def test_batch_twin_skips_labelled_and_filled_rows(spark, docs, tmp_path):
    sink = str(tmp_path / "out")
    filled = docs.withColumns(
        {
            "llm_green_suggested": F.when(F.col("doc_id") < 3, "1"),
            "llm_confidence": F.lit("low"),
            "llm_rationale": F.lit("r"),
        }
    )
    incremental.label_incremental_batch(filled.where("doc_id < 12"), standins.kv_model, sink)
    incremental.label_incremental_batch(filled, standins.kv_model, sink)
    got = [r.doc_id for r in spark.read.parquet(sink).collect()]
    assert sorted(got) == list(range(3, 25))


def test_rows_are_spread_over_the_asked_tasks(spark):
    one = spark.createDataFrame(DOCS, "doc_id int, text string").coalesce(1)
    echo = lambda: lambda prompts: [p + "!" for p in prompts]
    spread = inference.batch_generate(one, echo, "text", tasks=5).select("doc_id", "reply", F.spark_partition_id().alias("p"))
    rows = spread.collect()
    assert len({r.p for r in rows}) == 5 and sorted(r.doc_id for r in rows) == list(range(25))
    assert classify.embed_batches(one, lambda: lambda t: [[1.0]] * len(t), tasks=3).count() == 25


def dies_at(log, n):
    """The key-value stand-in, which ends the run at the n-th prompt."""

    def make():
        answer = standins.kv_model()

        def generate(prompts):
            with open(log, "a") as f:
                f.writelines("x\n" for _ in prompts)
            if len(log.read_text().splitlines()) >= n:
                raise RuntimeError("lost")
            return answer(prompts)

        return generate

    return make


def test_a_killed_run_repeats_open_tasks_only(spark, tmp_path):
    """40 rows on 20 tasks of two rows; some tasks end before the run does."""
    rows = spark.range(40).select(F.col("id").cast("int").alias("doc_id"), F.format_string("claim %d", "id").alias("text")).repartition(20)
    log, sink = tmp_path / "log", str(tmp_path / "out")
    with pytest.raises(Exception, match="lost"):
        incremental.label_incremental_batch(rows, dies_at(log, 25), sink, tasks=20)
    kept, first = spark.read.parquet(sink).count(), calls(log)
    assert 0 < kept < 40
    log.write_text("")
    incremental.label_incremental_batch(rows, counting_model(str(log)), sink, tasks=20)
    assert calls(log) == 40 - kept and first + calls(log) < 80
    assert sorted(r.doc_id for r in spark.read.parquet(sink).collect()) == list(range(40))


def test_a_killed_debate_goes_on(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").cast("int").alias("doc_id"), F.format_string("claim %d", "id").alias("text"))
    log, run = tmp_path / "log", str(tmp_path / "run")
    models = {"advocate": standins.argument_model("advocate"), "skeptic": dies_at(log, 25), "judge": standins.judge_model}
    with pytest.raises(Exception, match="lost"):
        inference.debate(rows, models, run=run, tasks=20)
    kept = spark.read.parquet(f"{run}/arguments").count()
    assert 0 < kept < 40
    log.write_text("")
    models["skeptic"] = counting_model(str(log))
    out = inference.debate(rows, models, run=run, tasks=20)
    assert calls(log) == 40 - kept and sorted(r.doc_id for r in out.collect()) == list(range(40))
    again = inference.debate(rows, models, run=run, tasks=20)
    assert calls(log) == 40 - kept and again.count() == 40
    with pytest.raises(Exception, match="null doc_id"):
        inference.debate(spark.createDataFrame([(None, "x")], "doc_id int, text string"), models, run=run)


def test_resumed_scans_its_input_once(spark, docs, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = docs.mapInPandas(look, docs.schema)
    inference.resumed(rows, str(tmp_path / "r"), "doc_id", lambda d: d.withColumn("n", F.length("text")), tasks=7)
    assert seen.value == 25


def test_one_call_per_key_over_ten_batches_that_never_read_the_sink(spark, tmp_path):
    log, source, sink, checkpoint = tmp_path / "log", str(tmp_path / "in"), tmp_path / "out", str(tmp_path / "progress")
    model = counting_model(str(log))
    for k in range(10):  # each batch repeats half of the one before, and a key of the first
        ids = [*range(10 * k, 10 * k + 20), 0, 0]
        spark.createDataFrame([(i, f"claim {i}") for i in ids], "doc_id int, text string").write.mode("append").parquet(source)
        run_stream(spark, source, model, str(sink), checkpoint)
        if k:  # a batch that looked into earlier ones would fail on this
            (sink / f"batch_id={k - 1}" / "broken.parquet").write_text("no parquet")
    assert calls(log) == 110
    for k in range(9):
        (sink / f"batch_id={k}" / "broken.parquet").unlink(missing_ok=True)
    assert sorted(r.doc_id for r in spark.read.parquet(str(sink)).collect()) == list(range(110))


def test_a_sink_of_another_checkpoint_is_an_error(spark, docs, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    docs.write.parquet(source)
    for name in ("a", "b"):
        docs.withColumn("doc_id", F.col("doc_id") + (100 if name == "b" else 0)).write.mode("append").parquet(source)
        run_stream(spark, source, standins.kv_model, sink, str(tmp_path / "first"))
    with pytest.raises(Exception, match="does not know"):
        run_stream(spark, source, standins.kv_model, sink, str(tmp_path / "second"))


def test_column_functions_are_set_up_once_per_task(spark, tmp_path):
    log = tmp_path / "setups"

    def make():
        with open(log, "a") as f:
            f.write("x\n")
        return lambda a, b=None: a.str.len() if b is None else a.str.len() + b

    df = spark.range(0, 1000, 1, 4).select("id", F.format_string("%04d", "id").alias("s"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    one, two = inference.map_column(make, "bigint"), inference.map_columns(make, "bigint")
    assert df.select(one("s").alias("n")).agg(F.sum("n")).first()[0] == 4000
    assert calls(log) == 4
    assert df.select(two("s", "id").alias("n")).agg(F.sum("n")).first()[0] == 4000 + 499_500
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert calls(log) == 8


def test_python_functions_get_batches_of_bounded_bytes(spark):
    """Rows of 20 kB: ten thousand of them would be 200 MB at once."""
    df = spark.range(1000, numPartitions=1).selectExpr("id AS doc_id", "repeat('x', 20000) AS text")
    sized = inference.map_batches(df, lambda f: f.assign(n=len(f))[["doc_id", "n"]], "doc_id long, n long")
    model = lambda: lambda prompts: [p + str(len(prompts)) for p in prompts]
    asked = inference.batch_generate(df, model, "text", batch=10_000).selectExpr("doc_id", "CAST(reply AS long) AS n")
    counted = inference.map_column(lambda: lambda texts: texts.map(len) * 0 + len(texts), "bigint")
    for got in (sized, asked, df.select("doc_id", counted("text").alias("n"))):
        rows = got.collect()
        assert sorted(r.doc_id for r in rows) == list(range(1000))
        assert max(r.n for r in rows) * 20_000 < 6_000_000
