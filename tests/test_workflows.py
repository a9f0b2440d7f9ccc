import pytest
from pyspark.sql import functions as F

from silverloop.operators import classify
from silverloop.plans import workflows


@pytest.fixture(scope="module")
def corpus(spark):
    words = F.when(F.col("id") % 2 == 0, "solar wind filter").otherwise("gear armor engine")
    split = F.when(F.col("id") % 5 < 3, "train_silver").when(F.col("id") % 5 == 3, "eval_silver").otherwise("pool_unlabeled")
    return spark.range(60).select(
        F.col("id").cast("string"),
        F.concat(words, F.lit(" claim "), F.col("id").cast("string")).alias("text"),
        (F.col("id") % 2 == 0).cast("int").cast("string").alias("is_green_silver"),
        split.alias("split"),
    )


def values(rows):
    return {(r.section, r["class"], r.metric): r.value for r in rows.collect()}


def test_replace_round_learns(spark, corpus):
    gold = spark.createDataFrame([("4.0", "1", 1)], "doc_id string, is_green_human string, source_pos int")
    model, rows = workflows.replace_round(corpus, gold, "r")
    got = values(rows)
    assert got[("summary", None, "n")] == 12 and got[("summary", None, "accuracy")] == 1.0
    assert got[("summary", None, "log_loss")] < 0.5
    assert [type(s).__name__ for s in model.stages][-1] == "LogisticRegressionModel"


def test_rounds_refuse_empty_inputs(spark, corpus):
    gold = spark.createDataFrame([("999", "1", 1)], "doc_id string, is_green_human string, source_pos int")
    with pytest.raises(ValueError, match="no reviewed id is in the corpus"):
        workflows.replace_round(corpus, gold, "r")
    reviewed = spark.createDataFrame([("t", "maybe")], "text string, is_green_human_2 string")
    with pytest.raises(ValueError, match="no reviewed row has a valid"):
        workflows.append_round(corpus, reviewed, "is_green_human_2", "r")
    with pytest.raises(ValueError, match="no evaluation rows"):
        good = reviewed.withColumn("is_green_human_2", F.lit("1"))
        workflows.append_round(corpus.where("split = 'train_silver'"), good, "is_green_human_2", "r")
    with pytest.raises(ValueError, match="missing columns: .'split'."):
        workflows.append_round(corpus.drop("split"), good, "is_green_human_2", "r")


def test_review_list_with_a_fitted_model(spark, corpus):
    vectors = corpus.select("id", F.array(F.col("id").cast("double") / 60, F.lit(1.0)).alias("embedding"))
    labelled = vectors.withColumn("label", (F.col("id").cast("int") >= 30).cast("int"))
    model = classify.fit_logreg(labelled)
    listed = workflows.review_list(corpus.where("split = 'pool_unlabeled'"), vectors, model, k=4)
    assert listed.columns == [
        "doc_id", "text", "p_green", "u", "llm_green_suggested", "llm_confidence", "llm_rationale", "is_green_human", "human_notes",
    ]
    assert listed.count() == 4
    pool = classify.predict_proba(vectors.join(corpus.where("split = 'pool_unlabeled'"), "id"), model).collect()
    best = sorted(pool, key=lambda r: (-(1 - 2 * abs(r.p_green - 0.5)), r.id))[:4]
    assert {r.doc_id for r in listed.collect()} == {r.id for r in best}


def test_silver_corpus(spark):
    wide = spark.range(200).select("id", (F.col("id") % 4 == 0).cast("int").alias("Y02A"), F.lit(None).cast("int").alias("Y02B"))
    got = workflows.silver_corpus(wide, "Y02", 20)
    assert {(r.split, r["count"]) for r in got.groupBy("split").count().collect()} == {
        ("train_silver", 24), ("eval_silver", 8), ("pool_unlabeled", 8),
    }
    assert got.groupBy("is_green_silver").count().where("count = 20").count() == 2


def test_retraining_on_vectors(spark, corpus):
    gold = spark.createDataFrame([("4.0", "1", 1)], "doc_id string, is_green_human string, source_pos int")
    encoder = lambda: classify.hashed_mean_encoder(dim=64)
    model, rows = workflows.replace_round(corpus, gold, "r", make_encoder=encoder)
    got = values(rows)
    assert got[("summary", None, "n")] == 12 and got[("summary", None, "accuracy")] == 1.0
    assert len(model.stages) == 1 and model.stages[0].numFeatures == 64
    with pytest.raises(ValueError, match="not both"):
        workflows.replace_round(corpus, gold, "r", make_encoder=encoder, pipeline=classify.text_pipeline())


def test_documents_are_embedded_where_they_lie(spark):
    texts = [(0, None), (1, ""), (2, " \t "), (3, "a b a"), (4, " ".join(f"w{i}" for i in range(1000)))]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    for window, batch in ((256, 32), (7, 3), (5000, 1)):
        out = classify.embed_documents(docs, lambda: classify.hashed_mean_encoder(dim=8, max_tokens=window), window=window, batch=batch)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.doc_id: r.embedding for r in out.collect()}
        whole = classify.hashed_mean_encoder(dim=8)([t or "" for _, t in texts])
        assert all(abs(a - b) < 1e-6 for i in got for a, b in zip(got[i], whole[i], strict=True))
