import hashlib

import pytest
from pyspark.sql import functions as F

from silverloop.operators import joins, sampling


def table(spark, n, parts=4):
    return spark.range(n).select(F.col("id"), (F.col("id") % 7 == 0).cast("int").alias("label")).repartition(parts)


def by_hash(ids, seed=42):
    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_split_is_exact_and_the_same_for_any_partitioning(spark, parts):
    got = {r.id: r.split for r in sampling.split_60_20_20(table(spark, 501, parts), "id").collect()}
    order = by_hash(range(501))
    want = {i: "train_silver" if k < 301 else "eval_silver" if k < 401 else "pool_unlabeled" for k, i in enumerate(order)}
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_split_of_tiny_tables_covers_every_row(spark, n):
    assert sampling.split_60_20_20(table(spark, n, 1), "id").count() == n


def test_class_sample_takes_exactly_n_of_each(spark):
    got = [r.id for r in sampling.class_sample(table(spark, 700), "label", 40, "id").collect()]
    ones = by_hash(i for i in range(700) if i % 7 == 0)[:40]
    zeros = by_hash(i for i in range(700) if i % 7)[:40]
    assert sorted(got) == sorted(ones + zeros)


@pytest.mark.parametrize("rows", [0, 70])
def test_class_sample_fails_on_a_short_class(spark, rows):
    with pytest.raises(Exception, match="fewer than 11"):
        sampling.class_sample(table(spark, rows, 1), "label", 11, "id").collect()


def test_cap_sample(spark):
    df = table(spark, 100)
    assert sorted(r.id for r in sampling.cap_sample(df, 30, "id").collect()) == sorted(by_hash(range(100))[:30])
    assert sampling.cap_sample(df, 1000, "id").count() == 100
    assert sampling.cap_sample(df, None, "id").count() == 100


def test_a_cut_inside_one_bucket(spark):
    """With one hex digit all cuts fall inside full buckets."""
    df = table(spark, 400)
    order = sampling.seeded_key(42, "id")
    for want in (1, 17, 399, 400):
        cuts = sampling.hash_cuts(df, order, lambda t: {"all/n": F.lit(want)}, digits=1)
        got = df.where(order <= F.try_element_at(cuts, F.lit("all/n")))
        assert sorted(r.id for r in got.collect()) == sorted(by_hash(range(400))[:want])


def test_seeded_shuffle_is_a_permutation(spark):
    got = sampling.seeded_shuffle(table(spark, 300), "id").orderBy("row_index").collect()
    assert [r.row_index for r in got] == list(range(300))
    assert [r.id for r in got] == by_hash(range(300))


def test_running_total_with_one_bucket_per_digit(spark):
    df = table(spark, 200)
    got = {r.id: r.t for r in sampling.running_total(df, sampling.seeded_key(1, "id"), F.col("id"), "t", digits=1).collect()}
    total = 0
    for i in by_hash(range(200), 1):
        assert got[i] == total
        total += i


def test_stratified_split_sizes(spark):
    df = spark.range(100).select("id", (F.col("id") < 13).cast("int").alias("label"))
    got = {(r.label, r.part): r["count"] for r in sampling.stratified_split(df, "label", "id").groupBy("label", "part").count().collect()}
    assert got == {(0, "train"): 74, (0, "test"): 13, (1, "train"): 11, (1, "test"): 2}


def test_dedupe_keeps_last_and_is_idempotent(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "k string, pos int, v string")
    once = sampling.dedupe_keep_last(df, "k", "pos")
    assert {tuple(r) for r in once.collect()} == {("a", 3, "z"), ("b", 1, None)}
    assert sampling.dedupe_keep_last(once, "k", "pos").count() == 2
    assert once.columns == df.columns


def test_dedupe_with_a_hot_key(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    assert sampling.dedupe_keep_last(df, "k", "id").where("k = -1").first().id == 29_997


def test_top_uncertain_breaks_ties_by_id(spark):
    rows = [(3, 0.5), (1, 0.5), (2, 0.9), (4, 0.1), (5, float("nan")), (6, None)]
    df = spark.createDataFrame(rows, "id int, u double")
    top = sampling.top_uncertain(df, 3)
    assert [r.id for r in top.collect()] == [2, 1, 3]
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def test_complement(spark):
    df = table(spark, 50)
    drawn = sampling.cap_sample(df, 20, "id")
    rest = joins.complement(df, drawn, "id")
    assert rest.count() == 30 and rest.join(drawn, "id").count() == 0


def test_no_sampling_operator_shuffles_text(spark):
    """The plan of the rows themselves has no exchange, only its scalar sub-query has."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for out in (sampling.split_60_20_20(df, "doc_id"), sampling.cap_sample(df, 10, "doc_id")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan.split("Subquery")[0] or "scalar-subquery" in plan
        physical = out._jdf.queryExecution().executedPlan()
        kinds = [physical.getClass().getSimpleName()]
        main = physical.toString().split("Subquery subquery")[0]
        assert "Exchange" not in main, (kinds, main)


def test_copies_of_a_key_stay_together(spark):
    """A third of the rows share one key; it lies on one side of the cut and counts in full."""
    ids = [7] * 100 + list(range(1000, 1200))
    df = spark.createDataFrame([(i,) for i in ids], "id int").repartition(5)
    order = sampling.seeded_key(42, "id")
    ranked = by_hash(ids)
    for want in (1, 60, 150, 299):
        got = sorted(r.id for r in sampling.cap_sample(df, want, "id").collect())
        last = ranked[want - 1]
        expected = ranked[: want] + ([last] * (ranked.count(last) - ranked[:want].count(last)))
        assert got == sorted(expected)


@pytest.mark.parametrize("equal", [False, True])
def test_a_key_with_a_third_of_the_rows_spreads_over_buckets(spark, equal):
    """Rows of one key are numbered in one stretch, by many tasks, whether they differ or not."""
    n = 3000
    hot = F.col("id") % 3 == 0
    df = spark.range(n).select(F.when(hot, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.when(hot & F.lit(equal), F.lit(0)).otherwise(F.col("id")).alias("v"))
    out = sampling.seeded_shuffle(df, "k", bucket_rows=60)
    got = sorted((r.row_index, r.k, r.v) for r in out.collect())
    assert [i for i, _, _ in got] == list(range(n))
    assert [k for _, k, _ in got] == sorted((-1 if i % 3 == 0 else i for i in range(n)), key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())
    assert sorted(v for _, _, v in got) == sorted(0 if equal and i % 3 == 0 else i for i in range(n))
    if not equal:
        marked = df.withColumn("_o", F.concat(sampling.seeded_key(42, "k"), F.lpad(F.lower(F.hex(F.xxhash64("k", "v"))), 16, "0")))
        bucket, left = sampling._refined(marked, 4, 60)
        assert left == [] and marked.groupBy(bucket).count().agg(F.max("count")).first()[0] <= 60


def test_packing_a_hot_key_loses_no_token(spark):
    from silverloop.operators import text

    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("id"), F.format_string("a%d b%d c", "id", "id").alias("text"))
    same = spark.range(500).select(F.lit(-2).alias("id"), F.lit("x y").alias("text"))
    blocks = text.sequence_pack(df.unionByName(same), "id", 64, bucket_rows=40).orderBy("block_id").collect()
    assert [b.n_tokens for b in blocks] == [64] * (len(blocks) - 1) + [(900 * 3 + 1000) % 64 or 64]
    assert sorted(" ".join(b.text for b in blocks).split()) == sorted([w for i in range(900) for w in (f"a{i}", f"b{i}", "c")] + ["x", "y"] * 500)


def test_bucket_digits_are_bounded(spark):
    with pytest.raises(ValueError, match="1 to 4"):
        sampling.running_total(table(spark, 5), F.lit("a"), F.lit(1), "t", digits=5)
