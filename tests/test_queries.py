"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import importlib.util
from pathlib import Path

import pytest

from compare import check, connect

from silverloop.plans.oracles import ORACLES
from silverloop.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("spark_entry", Path(__file__).resolve().parents[1] / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)

@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_no_query_goes_without_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    assert check(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR) is None


def test_review_list_joins_numbers_not_vectors_or_text(spark):
    df = entry.queries()["review_list"](spark, SF_DIR)
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=100" in physical
    exchanged = [line for line in physical.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanged and "embedding" not in "".join(exchanged)


def test_streamed_documents_may_be_a_folder_of_files(spark, tmp_path):
    run, docs = entry.queries()["label_incremental"], spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/some/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert sorted(run(spark, f"{tmp_path}/some").collect()) == sorted(run(spark, SF_DIR).collect())
    assert run(spark, f"{tmp_path}/none").count() == 0
