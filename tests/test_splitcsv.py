"""CSV by byte ranges: against one-task reading, over many ranges."""

from __future__ import annotations

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from silverloop.operators import cleaning, sampling
from silverloop.sources import readers, splitcsv, writers


@contextmanager
def ranges_of(spark, size):
    """Ranges of so many bytes, and a task each."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": str(size)}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def awkward(rng, n):
    units = ["a", "word", ",", '"', '""', "\n", "\r\n", " ", "é", "x\ny", '",', ',"', "\n\n", "'", ";"]
    for i in range(n):
        yield i, "".join(rng.choice(units) for _ in range(rng.choice([0, 1, 3, 8, 40]))) + "|", rng.choice([None, "", "plain", "two\nlines"])


SCHEMA = "id int, text string, more string"


@pytest.mark.parametrize("size", [64, 257, 4096, 1 << 20])
def test_ranges_give_what_one_task_gives(spark, tmp_path, size):
    path = str(tmp_path / "t.csv")
    df = spark.createDataFrame(list(awkward(random.Random(size), 400)), SCHEMA)
    writers.write_csv(df.coalesce(1), path)
    one = spark.read.schema(SCHEMA).options(**readers.CSV_OPTIONS, multiLine=True).csv(path)
    with ranges_of(spark, size):
        many = readers.read_table_auto(spark, path, SCHEMA)
        assert rows_of(many, "*") == rows_of(one, "*") == rows_of(df.replace("", None, ["more"]), "*")
        if size < 4096:
            assert splitcsv._lines(spark, path, False).rdd.getNumPartitions() > 10


def test_records_longer_than_ranges_and_open_quotes(spark, tmp_path):
    path = tmp_path / "t.csv"
    long = "\n".join(f"line {i}, with a comma" for i in range(200))
    path.write_text(f'id,text\r\n1,"{long}"\r\n2,x\r\n\r\n3,"a ""quoted"" word"\r\n4,5" pipe\r\n5,"never closed\n6,y\n')
    with ranges_of(spark, 100):
        got = rows_of(splitcsv.records(spark, str(path)), "record")
    assert got == sorted([("id,text",), (f'1,"{long}"',), ("2,x",), ('3,"a ""quoted"" word"',), ('4,5" pipe',), ('5,"never closed\n6,y',)])


def test_states_of_lines():
    cases = [('a,b', 0, 0), ('a,"b', 0, 1), ('a,"b"', 0, 0), ('"a,""', 0, 1), ('"a""",b', 0, 0), ('5" x,"', 0, 1), ("plain", 1, 1), ('end",a', 1, 0), ('end","b', 1, 1), ('""', 1, 1), ('"', 1, 0), ('"\r', 1, 0), ("", 1, 1), ('"a" b,c', 0, 0)]
    for line, before, after in cases:
        assert splitcsv.ends_inside(line, bool(before)) == bool(after), line


def test_files_without_rows(spark, tmp_path):
    for name, text, columns in (("e.csv", "", []), ("h.csv", "a,b\n", ["a", "b"])):
        (tmp_path / name).write_text(text)
        got = readers.read_table_auto(spark, str(tmp_path / name))
        assert got.columns == columns and got.count() == 0
        assert readers.read_csv_strings(spark, str(tmp_path / name)).count() == 0


def test_types_by_all_values(spark, tmp_path):
    (tmp_path / "t.csv").write_text('﻿i,l,d,day,"a\nname",flag,none,mixed\n1,1,1,2024-01-02,x,true,,1\n2,5000000000,.5,2024-02-03,"y\nz",false,,b\n')
    got = readers.read_table_auto(spark, str(tmp_path / "t.csv"))
    assert got.dtypes == [("i", "int"), ("l", "bigint"), ("d", "double"), ("day", "date"), ("a\nname", "string"), ("flag", "boolean"), ("none", "string"), ("mixed", "string")]
    assert got.agg(F.sum("l"), F.sum("d")).first() == (5000000001, 1.5)


def test_position_orders_rows_of_several_files(spark, tmp_path):
    """Keep-last and the row cap by the order of the files, from CSV and Parquet alike."""
    rows = [(i, i % 7, f"v{i}\nsecond line") for i in range(600)]
    df = spark.createDataFrame(rows, "i int, k int, text string").repartitionByRange(3, "i").sortWithinPartitions("i")
    writers.write_csv(df, str(tmp_path / "t.csv"))
    df.write.parquet(str(tmp_path / "t.parquet"))
    with ranges_of(spark, 1000):
        for name in ("t.csv", "t.parquet"):
            read = readers.read_table_auto(spark, str(tmp_path / name), df.schema, position="at")
            last = sampling.dedupe_keep_last(read, "k", "at")
            assert rows_of(last, "k", "i") == sorted([(k, max(i for i, x, _ in rows if x == k)) for k in range(7)], key=str)
            assert rows_of(cleaning.row_cap(read, 25, "at"), "i") == sorted([(i,) for i in range(25)], key=str)


def test_files_that_hold_no_row_change_nothing(spark, tmp_path):
    """Small files beside a large one: ranges are the same in both looks."""
    df = spark.createDataFrame([(i, "two\nlines, " * 50) for i in range(500)], "id int, text string")
    writers.write_csv(df.coalesce(1), str(tmp_path / "t.csv"))
    for k in range(3):
        (tmp_path / "t.csv" / f"none{k}.csv").write_text("id,text\n")
    with ranges_of(spark, 9_999):
        assert rows_of(readers.read_table_auto(spark, str(tmp_path / "t.csv"), df.schema), "*") == rows_of(df, "*")


def test_other_ranges_after_the_first_look_are_an_error(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    writers.write_csv(spark.createDataFrame([(i, "a\nb") for i in range(500)], "id int, text string").coalesce(1), path)
    with ranges_of(spark, 500):
        read = readers.read_table_auto(spark, path, "id int, text string")
    with ranges_of(spark, 333), pytest.raises(Exception, match="changed after the first look"):
        read.collect()


def test_text_is_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    writers.write_csv(spark.createDataFrame([(1, "a\nb")], "id int, text string"), path)
    plan = readers.read_table_auto(spark, path, "id int, text string")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
