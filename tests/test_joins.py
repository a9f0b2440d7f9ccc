import pytest
from pyspark.sql import functions as F

from silverloop import contracts
from silverloop.operators import assembly, cleaning, joins

CORPUS = [
    ("1", "a", "0", "train_silver"), ("2", "b", "1", "train_silver"), ("3", "c", "1.0", "eval_silver"),
    ("4", None, "0", "pool_unlabeled"), ("5", "e", "bad", "train_silver"),
]
GOLD = [("1.0", "1", 1), ("DOC-1", "0", 2), (" 4 ", "1", 3), ("3", "x", 4), (None, "1", 5), ("99", "1", 6)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "id string, text string, is_green_silver string, split string")


@pytest.fixture(scope="module")
def gold(spark):
    return spark.createDataFrame(GOLD, "doc_id string, is_green_human string, source_pos int")


def test_gold_join_takes_the_last_valid_label(corpus, gold):
    got = {r.id: r.is_green_human for r in joins.gold_join(corpus, gold).collect()}
    assert got == {"1": 0, "2": None, "3": None, "4": 1, "5": None}


def test_augment_replace(corpus, gold):
    got = sorted(tuple(r) for r in assembly.augment_replace(corpus, gold).collect())
    assert got == [("", 1), ("a", 0), ("b", 1)]


def test_eval_rows_and_overlap(spark, corpus):
    gold = spark.createDataFrame([("3", "0", 1)], "doc_id string, is_green_human string, source_pos int")
    assert [tuple(r) for r in assembly.eval_rows(corpus).collect()] == [("c", 1)]
    assert assembly.eval_rows(corpus, gold=gold, exclude_eval_gold=True).count() == 0
    assert assembly.eval_gold_overlap(corpus, gold).first()[0] == 1


def test_augment_append_keeps_repeats(spark, corpus):
    reviewed = spark.createDataFrame([("x", "1"), ("x", "1"), (None, "0"), ("y", "maybe")], "text string, is_green_human_2 string")
    got = sorted(tuple(r) for r in assembly.augment_append(corpus, reviewed).collect())
    assert got == [("", 0), ("a", 0), ("b", 1), ("x", 1), ("x", 1)]


def test_exclude_ids(corpus, gold):
    assert sorted(r.id for r in joins.exclude_ids(corpus, gold).collect()) == ["2", "5"]
    plain = joins.exclude_ids(corpus, gold, normalize=False)
    assert sorted(r.id for r in plain.collect()) == ["1", "2", "5"]


def test_embedding_align(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    vecs = spark.createDataFrame([(1, [0.5]), (2, [1.5]), (3, [2.5])], "id int, embedding array<double>")
    assert {(r.id, r.embedding[0]) for r in joins.embedding_align(docs, vecs).collect()} == {(1, 0.5), (2, 1.5)}
    short = vecs.where("id <> 2")
    with pytest.raises(Exception, match="no vector for id 2"):
        joins.embedding_align(docs, short).collect()
    assert joins.embedding_align(docs, short, on_missing="drop").count() == 1
    with pytest.raises(Exception, match="more than one vector for id 1"):
        joins.embedding_align(docs, vecs.union(vecs.where("id = 1"))).collect()


def test_token_lookup(spark):
    sentences = spark.createDataFrame([(1, ["b", "a", "b"])], "s int, tokens array<string>")
    words = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "word string, vec array<double>")
    got = sorted((r.pos, r.token, r.vec[0]) for r in joins.token_lookup(sentences, words).collect())
    assert got == [(0, "b", 2.0), (1, "a", 1.0), (2, "b", 2.0)]
    with pytest.raises(Exception, match="unknown word: b"):
        joins.token_lookup(sentences, words.where("word = 'a'")).collect()
    assert joins.token_lookup(sentences, words.where("word = 'a'"), on_unknown="drop").count() == 1


def test_any_positive_label(spark):
    rows = [(1, 0, 0), (2, 1, None), (3, None, None), (4, 2, -2)]
    df = spark.createDataFrame(rows, "id int, Y02A int, Y02B int")
    got = {r.id: r.is_green_silver for r in cleaning.any_positive_label(df, "Y02").collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0}
    with pytest.raises(ValueError, match="no column starts with"):
        cleaning.any_positive_label(df, "Z")


def test_any_positive_label_over_700_columns(spark):
    df = spark.range(3).select("id", *[(F.col("id") == 2).cast("int").alias(f"Y02_{i}") for i in range(700)])
    assert [r[0] for r in cleaning.any_positive_label(df, "Y02").orderBy("id").select("is_green_silver").collect()] == [0, 0, 1]


def test_pending_filter(spark):
    rows = [("1", "low", "x"), ("1", "", "x"), ("2", "low", "x"), ("", "", ""), (None, None, None)]
    df = spark.createDataFrame(rows, "llm_green_suggested string, llm_confidence string, llm_rationale string")
    assert cleaning.pending_filter(df).count() == 4


def test_row_cap(spark):
    df = spark.range(100).repartition(7)
    assert sorted(r.id for r in cleaning.row_cap(df, 5, "id").collect()) == [0, 1, 2, 3, 4]
    assert cleaning.row_cap(df, None, "id").count() == 100
    assert cleaning.row_cap(df, 0, "id").count() == 0


def test_split_filter_pushes_the_exact_form(spark, corpus):
    messy = corpus.withColumn("split", F.concat(F.lit(" "), F.upper("split")))
    assert cleaning.split_filter(messy, "train_silver").count() == 0
    assert cleaning.split_filter(messy, "train_silver", normalize=True).count() == 3


def test_ensure_columns(corpus):
    got = cleaning.ensure_columns(corpus, {"text": "no", "note": "n"})
    assert got.columns == [*corpus.columns, "note"] and got.where("text = 'no'").count() == 0


def test_union_all_by_name(spark, corpus):
    other = spark.createDataFrame([("z", "9")], "text string, id string")
    got = assembly.union_all(corpus, other)
    assert got.count() == 6 and got.where("id = '9' AND split IS NULL AND text = 'z'").count() == 1


def test_contracts(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (None,), (2,)], "id int")
    assert contracts.check_contract(df, ["id"], "id").first().asDict() == {
        "n_rows": 5, "n_null_keys": 1, "n_duplicate_keys": 2, "has_rows": True,
    }
    with pytest.raises(ValueError, match=r"missing columns: \['text'\]. Found: \['id'\]"):
        contracts.check_contract(df, ["id", "text"])
    with pytest.raises(ValueError, match="nothing here"):
        contracts.require_rows(df.where("id > 5"), "nothing here")


def test_a_hot_key_is_split_by_adaptive_execution(spark):
    """Half of the tokens are one word; with sizes scaled down the join splits its partition."""
    scaled = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in scaled}
    for k, v in scaled.items():
        spark.conf.set(k, v)
    try:
        tokens = spark.range(0, 60_000, 1, 8).select(
            "id", F.array(F.lit("hot"), F.concat(F.lit("w"), F.col("id") % 500)).alias("tokens")
        )
        words = spark.range(500).select(F.concat(F.lit("w"), "id").alias("word"), F.array(F.lit(1.0)).alias("vec"))
        words = words.union(spark.createDataFrame([("hot", [2.0])], "word string, vec array<double>"))
        joined = joins.token_lookup(tokens, words)
        counted = joined.select("id", F.col("vec")[0].alias("x"))
        assert len(counted.collect()) == 120_000
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
        assert counted.agg(F.sum("x")).first()[0] == 180_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
