from pyspark.sql import functions as F

from silverloop.functions import labels


def test_to_int01(column):
    cases = {
        None: None, " Green ": 1, "YES": 1, "n": 0, "not_green": 0, "1.0": 1, "1.9": 1, "2": 0, "-1": 0, "": None,
        "abc": None, "nan": None, "inf": None, "1e999": None, "1d": None, "true": 1, "False": 0,
    }
    assert column(labels.to_int01, list(cases)) == list(cases.values())


def test_to_int01_of_numbers_and_booleans(spark):
    df = spark.createDataFrame([(1.7, True), (0.3, False), (float("nan"), None)], "x double, b boolean")
    rows = df.select(labels.to_int01(F.col("x")), labels.to_int01(F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(1, 1), (0, 0), (None, None)]


def test_clean_doc_id(column):
    cases = {
        None: None, "  ": None, "12.0": "12", " 7 ": "7", "1e3": "1000", "2.5": "2", "3.5": "4", "-5": "-5", "US-12": "12",
        "abc": None, "nan": None, "inf": None, "9007199254740993": "9007199254740993", "007": "7", "-0": "0", "+5": "5",
        " 12 ": "12",
    }
    assert column(labels.clean_doc_id, list(cases)) == list(cases.values())


def test_binary_label(column):
    cases = {"0": 0, "1": 1, "1.0": 1, " 1 ": 1, "0.5": None, "true": None, "2": None, "": None, None: None}
    assert column(labels.binary_label, list(cases)) == list(cases.values())


def test_text_or_empty(column):
    assert column(labels.text_or_empty, [None, "a"]) == ["", "a"]
    assert column(lambda c: labels.text_or_empty(c, literal_null=True), [None, "a"]) == ["None", "a"]


def test_coerce_binary_by_type(spark):
    from silverloop.operators import cleaning

    numbers = spark.createDataFrame([(1.0, "a"), (0.5, "b"), (0.0, None), (None, "d")], "label double, text string")
    assert [tuple(r) for r in cleaning.coerce_binary(numbers).collect()] == [(1, "a"), (0, "")]
    flags = spark.createDataFrame([(True, "a"), (False, "b"), (None, "c")], "label boolean, text string")
    assert [tuple(r) for r in cleaning.coerce_binary(flags).collect()] == [(1, "a"), (0, "b")]
