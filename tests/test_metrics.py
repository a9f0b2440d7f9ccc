import math

import pytest

from silverloop.operators import metrics

GOLDEN = {
    "tuned": ([[4074, 930], [981, 4015]], dict(accuracy=0.8089, precision=0.8119312436804853, recall=0.8036429143314652, f1=0.807765818328136)),
    "round2": ([[3984, 1020], [864, 4132]], dict(accuracy=0.8116, precision=0.8020186335403726, recall=0.8270616493194556, f1=0.8143476547102877)),
    "round3": ([[13, 0], [2, 0]], dict(accuracy=0.8666666666666667, precision=0.0, recall=0.0, f1=0.0)),
}

REPORTS = {
    "tuned": [
        ("0", 0.8059, 0.8141, 0.81, 5004), ("1", 0.8119, 0.8036, 0.8078, 4996), ("accuracy", None, None, 0.8089, 10000),
        ("macro avg", 0.8089, 0.8089, 0.8089, 10000), ("weighted avg", 0.8089, 0.8089, 0.8089, 10000),
    ],
    "round2": [
        ("0", 0.8218, 0.7962, 0.8088, 5004), ("1", 0.802, 0.8271, 0.8143, 4996), ("accuracy", None, None, 0.8116, 10000),
        ("macro avg", 0.8119, 0.8116, 0.8116, 10000), ("weighted avg", 0.8119, 0.8116, 0.8116, 10000),
    ],
    "round3": [
        ("0", 0.8667, 1.0, 0.9286, 13), ("1", 0.0, 0.0, 0.0, 2), ("accuracy", None, None, 0.8667, 15),
        ("macro avg", 0.4333, 0.5, 0.4643, 15), ("weighted avg", 0.7511, 0.8667, 0.8048, 15),
    ],
}


def rows(spark, matrix):
    cells = [(t, p, matrix[t][p]) for t in (0, 1) for p in (0, 1)]
    df = spark.createDataFrame(cells, "y_true int, y_pred int, n int")
    return df.selectExpr("y_true", "y_pred", "explode(array_repeat(0, n)) AS z").drop("z")


@pytest.mark.parametrize("name", GOLDEN)
def test_published_matrices(spark, name):
    matrix, want = GOLDEN[name]
    df = rows(spark, matrix)
    got = metrics.prf_binary(df).first().asDict()
    for metric, value in want.items():
        assert got[metric] == pytest.approx(value, abs=1e-12)
    cells = {(r.true_label, r.pred_label): r.n for r in metrics.confusion_matrix(df).collect()}
    assert cells == {(t, p): matrix[t][p] for t in (0, 1) for p in (0, 1)}
    assert [tuple(r) for r in metrics.classification_report(df).collect()] == REPORTS[name]


def test_empty_input_gives_zeros(spark):
    df = spark.createDataFrame([], "y_true int, y_pred int")
    assert metrics.prf_binary(df).first().f1 == 0.0
    assert [r.n for r in metrics.confusion_matrix(df).collect()] == [0, 0, 0, 0]


def test_log_loss(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.1), (1, 0.0)], "y_true int, p_true double")
    want = -(math.log(0.8) + math.log(0.9) + math.log(1e-15)) / 3
    assert metrics.log_loss(df).first().log_loss == pytest.approx(want)


def test_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (0, None), (None, "a")], "label int, split string")
    assert [tuple(r) for r in metrics.label_counts(df).collect()] == [(1, 2), (0, 1)]
    assert {tuple(r) for r in metrics.split_distribution(df).collect()} == {("a", 2), (None, 2)}


def test_run_summary_alert(spark):
    data = [(None, True)] * 11 + [(1, False), (0, False)]
    df = spark.createDataFrame(data, "llm_green_suggested int, parse_failed boolean")
    assert tuple(metrics.run_summary(df).first()) == (13, 1, 1, 11, True, 11 / 13)
    assert not metrics.run_summary(df, alert_above=11).first().alert
    assert not metrics.run_summary(df.limit(10)).first().alert


def test_metric_rows(spark):
    df = rows(spark, GOLDEN["round3"][0])
    got = {(r.section, r["class"], r.metric): r.value for r in metrics.metric_rows(df, "x").collect()}
    assert got[("summary", None, "n")] == 15
    assert got[("confusion_matrix", "1", "pred_0")] == 2
    assert got[("report", "macro avg", "f1")] == 0.4643
