import numpy as np
import pytest
from pyspark.sql import functions as F

from silverloop.operators import attention, fold, joins, vectors

WORDS = {"bark": [0.3, 0.7], "rough": [0.2, 0.8], "oak": [0.9, 0.1], "tree": [0.8, 0.2], "backyard": [0.4, 0.6]}


@pytest.fixture(scope="module")
def sentence(spark):
    words = spark.createDataFrame(list(WORDS.items()), "word string, vec array<double>")
    text = spark.createDataFrame([(0, ["rough", "bark", "oak", "tree"])], "sentence int, tokens array<string>")
    return joins.token_lookup(text, words)


def flat(df, value):
    rows = sorted(df.collect(), key=lambda r: (r.q_pos, r.k_block))
    out = {}
    for r in rows:
        out.setdefault(r.q_pos, []).extend(r[value])
    return [out[k] for k in sorted(out)]


@pytest.mark.parametrize("block", [1, 3, 32])
def test_attention_of_the_worked_sentence(sentence, block):
    scores = flat(attention.attention_scores(sentence, block=block), "scores")
    assert scores[0] == pytest.approx([0.68, 0.62, 0.26, 0.32])
    weights = flat(attention.attention_weights(sentence, block=block), "weights")
    assert weights[0] == pytest.approx([0.303353, 0.285687, 0.199317, 0.211642], abs=1e-6)
    assert weights[2] == pytest.approx([0.183485, 0.198767, 0.321222, 0.296526], abs=1e-6)
    assert [sum(w) for w in weights] == pytest.approx([1.0] * 4)
    out = [r.context for r in attention.attention_output(sentence, block=block).orderBy("pos").collect()]
    want = [[0.495076, 0.504924], [0.513172, 0.486828], [0.622648, 0.377352], [0.604924, 0.395076]]
    assert np.allclose(out, want, atol=1e-6)


def test_attention_append(spark, sentence):
    extra = spark.createDataFrame([(0, 4, WORDS["backyard"])], "sentence int, pos bigint, vec array<double>")
    got = attention.attention_append(attention.attention_output(sentence), extra).orderBy("pos").collect()
    assert len(got) == 5 and got[4].context == WORDS["backyard"]


def test_attention_of_a_long_sentence_among_short_ones(spark):
    """One sentence holds most tokens, with gaps in its positions and large scores."""
    rng = np.random.default_rng(3)
    tokens, want = [], {}
    for s, n in [(0, 150), (1, 3), (2, 1)]:
        pos = sorted(rng.choice(1000, n, replace=False).tolist())
        v = rng.normal(size=(n, 5)) * 4
        tokens += [(s, p, row.tolist()) for p, row in zip(pos, v)]
        scores = v @ v.T
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        out = (e / e.sum(axis=1, keepdims=True)) @ v
        want.update({(s, p): o for p, o in zip(pos, out)})
    df = spark.createDataFrame(tokens, "sentence int, pos int, vec array<double>")
    got = {(r.sentence, r.pos): r.context for r in attention.attention_output(df, block=16).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize(("block", "m"), [(1, 2), (16, 5), (32, 500)])
def test_attention_top_against_all_pairs(spark, block, m):
    rng = np.random.default_rng(8)
    tokens, want = [], set()
    for s, n in [(0, 150), (1, 3), (2, 1)]:
        pos = sorted(rng.choice(1000, n, replace=False).tolist())
        v = rng.integers(-3, 4, size=(n, 3)).astype(float)  # equal scores are common
        tokens += [(s, p, row.tolist()) for p, row in zip(pos, v)]
        scores = v @ v.T
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        weights = e / e.sum(axis=1, keepdims=True)
        for i in range(n):
            for rank, k in enumerate(sorted(range(n), key=lambda k: (-scores[i, k], pos[k]))[:m]):
                want.add((s, pos[i], rank + 1, pos[k], scores[i, k], round(weights[i, k], 9)))
    df = spark.createDataFrame(tokens, "sentence int, pos int, vec array<double>")
    got = {(*tuple(r)[:5], round(r.weight, 9)) for r in attention.attention_top(df, m, block=block).collect()}
    assert got == want
    with pytest.raises(ValueError, match="1 or more"):
        attention.attention_top(df, 0)


def test_blocks_meet_once_and_travel_a_square_root_of_times(spark):
    df = spark.range(400).select(F.lit(1).alias("sentence"), F.col("id").alias("pos"), F.array(F.lit(1.0)).alias("vec"))
    met = attention._grid(df, "sentence", "pos", "vec", 4).select("row", "col", "q_block", "k_block").collect()
    assert len(met) == len({(r.q_block, r.k_block) for r in met}) == 100 * 100
    for side in ("q_block", "k_block"):
        assert len({(r.row, r.col, r[side]) for r in met}) == 100 * 10
    assert max(sum(r.row == i and r.col == j for r in met) for i in range(10) for j in range(10)) == 100


def test_cells_are_merged_where_they_are(spark):
    """Blocks that met are merged in their cell without a shuffle; the next one has a row per query and cell."""
    df = spark.range(400).select((F.col("id") % 3).alias("sentence"), F.col("id").alias("pos"), F.array(F.lit(1.0)).alias("vec"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = attention.attention_top(df, 2)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert not any("row#" in x and "q_pos#" in x for x in exchanges)
    assert sum("q_pos#" in x for x in exchanges) == 1


def test_masked_mean_pool(spark):
    rows = [(1, 1, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (1, 0, [9.0, 9.0]), (2, 0, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "doc_id int, mask int, vec array<float>")
    assert {r.doc_id: r.pooled for r in vectors.masked_mean_pool(df).collect()} == {1: [2.0, 3.0], 2: [0.0, 0.0]}


def test_uncertainty_and_argmax(spark):
    df = spark.createDataFrame([(0.0, [1.0, 3.0, 3.0]), (0.25, [2.0]), (0.5, [0.0, -1.0]), (1.0, [1.0, 2.0])], "p double, s array<double>")
    assert [r.u for r in vectors.uncertainty(df, "p").collect()] == [0.0, 0.5, 1.0, 0.0]
    assert [r.label for r in vectors.argmax_label(df, "s").collect()] == [1, 0, 0, 1]


def test_linear_score(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],)], "embedding array<float>")
    got = vectors.linear_score(df, [0.5, -1.0], 0.25).collect()
    assert got[0].p_green == pytest.approx(1 / (1 + np.exp(1.25))) and got[0].prediction == 0
    assert got[1].prediction == 1


def reference_trace(pairs, alpha, w):
    out = []
    for x, t in pairs:
        prediction = x * w
        gradient = 2 * x * (prediction - t)
        out.append((w, prediction, (t - prediction) ** 2, gradient, w - alpha * gradient))
        w = out[-1][-1]
    return out


def test_sgd_trace_of_the_worked_pairs(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 2.0), (1, 2, 2.0, 4.0), (1, 3, 3.0, 6.0)], "k int, pos int, x double, t double")
    got = [tuple(r)[4:] for r in fold.sgd_trace(df, "k", "pos", alpha=0.01).orderBy("pos").collect()]
    want = [(0.5, 0.5, 2.25, -3.0, 0.53), (0.53, 1.06, 8.6436, -11.76, 0.6476), (0.6476, 1.9428, 16.46087184, -24.3432, 0.891032)]
    assert np.allclose(got, want)


@pytest.mark.parametrize(("ranges", "fan"), [(1, 4096), (3, 2), (40, 3), (40, 4096)])
def test_sgd_trace_with_a_hot_key_over_ranges(spark, ranges, fan):
    rng = np.random.default_rng(5)
    sizes = {"hot": 400, "b": 9, "c": 1}
    rows, want = [], {}
    for key, n in sizes.items():
        pairs = rng.uniform(0.1, 3, size=(n, 2)).tolist()
        rows += [(key, i, x, t) for i, (x, t) in enumerate(pairs)]
        want.update({(key, i): w for i, w in enumerate(reference_trace(pairs, 0.02, 0.5))})
    df = spark.createDataFrame(rows, "k string, pos int, x double, t double").repartition(5)
    got = {(r.k, r.pos): tuple(r)[4:] for r in fold.sgd_trace(df, "k", "pos", alpha=0.02, ranges=ranges, fan=fan).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_sgd_trace_first_rows(spark):
    df = spark.range(100).select((F.col("id") % 4).alias("k"), "id", F.lit(1.0).alias("x"), F.lit(2.0).alias("t"))
    got = fold.sgd_trace(df, "k", "id", first_n=3)
    assert {(r.k, r.id) for r in got.collect()} == {(i % 4, i) for i in range(12)}


def test_prefix_maps_begin_anew():
    rng = np.random.default_rng(2)
    a, b, first = rng.normal(size=300), rng.normal(size=300), rng.random(300) < 0.05
    first[0] = True
    pa, pb = fold.prefix_maps(a, b, first)
    w = 1.0
    for i in range(300):
        w = a[i] * (1.0 if first[i] else w) + b[i]
        assert np.isclose(pa[i] + pb[i], w)


def test_sgd_trace_fails_on_a_null_key_or_position(spark):
    rows = [("a", 1, 1.0, 2.0), (None, 2, 1.0, 2.0)], [("a", 1, 1.0, 2.0), ("a", None, 1.0, 2.0)]
    for found, what in zip(rows, ("null k", "null pos"), strict=True):
        with pytest.raises(Exception, match=what):
            fold.sgd_trace(spark.createDataFrame(found, "k string, pos int, x double, t double"), "k", "pos").collect()


def test_sgd_trace_keeps_nulls_to_their_key(spark):
    rows = [(k, i, None if (k, i) == (3, 4) else 1.0 + i, 2.0) for k in range(8) for i in range(10)]
    df = spark.createDataFrame(rows, "k int, pos int, x double, t double")
    want = {(k, i): w for k in range(8) for i, w in enumerate(reference_trace([(1.0 + i, 2.0) for i in range(10)], 0.01, 0.5))}
    for ranges in (2, 9, 30):
        got = {(r.k, r.pos): tuple(r)[4:] for r in fold.sgd_trace(df, "k", "pos", alpha=0.01, ranges=ranges, fan=4).collect()}
        assert len(got) == 80
        assert all(np.allclose(got[x], want[x]) for x in got if x < (3, 4) or x[0] > 3)
        assert all(got[3, i][0] is None for i in range(5, 10))
    assert fold.sgd_trace(df.limit(0), "k", "pos").count() == 0


def test_sgd_trace_spreads_a_key_with_most_of_the_rows(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"), "id", F.lit(0.1).alias("x"), F.lit(0.2).alias("t"))
    traced = fold.sgd_trace(df, "k", "id", ranges=20, fan=4)
    sizes = [r["count"] for r in traced.where("k = -1").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 3_000
