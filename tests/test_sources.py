import pytest
from pyspark.sql import functions as F

from silverloop import session
from silverloop.operators import classify, joins
from silverloop.sources import readers, stores, writers

AWKWARD = [(1, ' say "hi", \n then\r\nleave '), (2, ""), (3, None), (4, "a,b;c\\d"), (5, '""'), (6, "line\n\n")]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(AWKWARD, "id int, text string")
    path = str(tmp_path / "t.CSV")
    writers.write_csv(df, path)
    # An empty field reads as null, quoted or not.
    assert sorted(map(tuple, readers.read_table_auto(spark, path, df.schema).collect())) == [(i, t or None) for i, t in AWKWARD]
    strings = readers.read_csv_strings(spark, path)
    assert dict(strings.dtypes) == {"id": "string", "text": "string"}
    assert sorted(map(tuple, strings.collect())) == [(str(i), t or "") for i, t in AWKWARD]
    assert sorted(map(tuple, readers.read_csv_strings(spark, path, ["id", "text"]).collect())) == [(str(i), t or "") for i, t in AWKWARD]


def test_inferred_csv_types(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    writers.write_csv(spark.createDataFrame([(1, 0.5)], "a int, b double"), path)
    assert dict(readers.read_table_auto(spark, path).dtypes) == {"a": "int", "b": "double"}


def test_unknown_extension(spark):
    with pytest.raises(ValueError, match="unsupported file type"):
        readers.read_table_auto(spark, "x.json")


def test_write_splits_prunes(spark, tmp_path):
    path = str(tmp_path / "splits")
    df = spark.range(30).select("id", F.concat(F.lit("s"), F.col("id") % 3).alias("split"))
    writers.write_splits(df, path)
    back = spark.read.parquet(path).where("split = 's1'")
    assert back.count() == 10
    assert "PartitionFilters: [isnotnull(split" in back._jdf.queryExecution().executedPlan().toString()


def test_embedding_store(spark, tmp_path):
    path = str(tmp_path / "emb")
    df = spark.range(20).select("id", F.array(F.col("id").cast("double"), F.lit(0.5)).alias("embedding"), F.lit(1).alias("y"))
    stores.save_embeddings(df, path, label="y")
    back = stores.load_embeddings(spark, path)
    assert dict(back.dtypes) == {"id": "bigint", "embedding": "array<float>", "y": "int"} and back.count() == 20


def test_model_store(spark, tmp_path):
    df = spark.createDataFrame([([float(i), 1.0], int(i > 4)) for i in range(10)], "embedding array<double>, label int")
    model = classify.fit_logreg(df)
    stores.save_model(model, str(tmp_path / "m"))
    again = stores.load_model(str(tmp_path / "m"))
    a, b = (classify.predict_proba(df, m).orderBy("p_green").collect() for m in (model, again))
    assert a == b


def test_a_run_written_twice_stands_once(spark, tmp_path):
    path = str(tmp_path / "metrics")
    rows = [(r, "s", None, "m", v) for r, v in (("007", 1.0), ("b/c=d", 2.0), (None, 3.0))]
    df = spark.createDataFrame(rows, "run string, section string, class string, metric string, value double")
    for _ in range(2):
        stores.append_metrics(df, path)
    stores.append_metrics(df.where("run = '007'").withColumn("value", F.lit(9.0)), path)
    got = {(r.run, r.value) for r in stores.load_metrics(spark, path).collect()}
    assert got == {("007", 9.0), ("b/c=d", 2.0), (None, 3.0)} and stores.load_metrics(spark, path).count() == 3


def test_bucketed_stores_join_without_an_exchange(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("docs", "vecs")]
    docs = spark.range(300).select("id", F.lit("x").alias("lang"))
    vecs = spark.range(0, 300, 2).select("id", F.array(F.col("id").cast("double")).alias("embedding"))
    stores.save_bucketed(docs, paths[0], "id", 12)
    stores.save_embeddings(vecs, paths[1], buckets=12)
    spark.sql(f"DROP TABLE {stores._table_name(paths[1])}")  # as another session finds it
    left, right = stores.load_bucketed(spark, paths[0]), stores.load_embeddings(spark, paths[1], bucketed=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    aligned = joins.embedding_align(left, right, on_missing="null")
    rows = aligned.collect()
    plan = aligned._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.id: r.embedding for r in rows} == {i: None if i % 2 else [float(i)] for i in range(300)}
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
    with pytest.raises(ValueError, match="written once"):
        stores.save_embeddings(vecs, paths[1], mode="overwrite", buckets=12)


def test_staged_tables_are_in_the_shared_folder(spark):
    staged = session.stage_table(spark.range(3), "x")
    assert staged.count() == 3
    assert all(session.shared_dir(spark) in f for f in staged.inputFiles())


def test_logreg_matches_the_penalised_optimum(spark):
    """The gradient of sum(loss) / c-scaled penalty is zero at the fitted weights."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=200) > 0).astype(int)
    df = spark.createDataFrame([(r.tolist(), int(v)) for r, v in zip(x, y)], "embedding array<double>, label int")
    fitted = classify.fit_logreg(df, c=0.7).stages[-1]
    w, b = fitted.coefficients.toArray(), fitted.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.allclose(0.7 * x.T @ (p - y) + w, 0, atol=0.02)
    assert abs((p - y).sum()) < 0.02
