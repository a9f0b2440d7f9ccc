import hashlib
import json

import pytest
from pyspark.sql import functions as F

from silverloop.functions import prompts
from silverloop.operators import text


def test_tokens(column):
    assert column(text.tokens_of, ["", " \n ", " a  b\tc\n", "a", None]) == [[], [], ["a", "b", "c"], ["a"], None]


def test_token_truncate(spark):
    df = spark.createDataFrame([("a b c d",), ("a",)], "text string")
    assert [r.tokens for r in text.token_truncate(df, 3).collect()] == [["a", "b", "c"], ["a"]]


@pytest.mark.parametrize("block,digits", [(1, 1), (5, 1), (8, 4), (10_000, 4)])
def test_sequence_pack_is_the_stream_cut_in_blocks(spark, block, digits):
    docs = {i: " ".join(f"d{i}w{j}" for j in range((i * 7) % 23)) for i in range(40)}
    docs[40] = " ".join(f"hot{j}" for j in range(400))
    df = spark.createDataFrame(list(docs.items()), "id int, text string").repartition(6)
    stream = []
    for i in sorted(docs, key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest()):
        stream += docs[i].split()
    want = [stream[i : i + block] for i in range(0, len(stream), block)]
    got = text.sequence_pack(df, "id", block, digits=digits).orderBy("block_id").collect()
    assert [r.block_id for r in got] == list(range(len(want)))
    assert [r.text.split(" ") for r in got] == want
    assert [r.n_tokens for r in got] == [len(w) for w in want]


def test_sft_records(spark):
    corpus = spark.createDataFrame(
        [
            ("1", "claim one", "1", " TRAIN_silver"), ("2", "claim two", "no", "train_silver"), ("3", None, "1", "train_silver"),
            ("4", "x", "abc", "train_silver"), ("5", "y", "1", "eval_silver"), ("6", "seen", "1", "train_silver"),
        ],
        "id string, text string, is_green_silver string, split string",
    )
    reviewed = spark.createDataFrame([("6.0",)], "doc_id string")
    got = {r.id: r.text for r in text.sft_records(corpus, reviewed).collect()}
    assert set(got) == {"1", "2"}
    assert got["1"].startswith("<s>[INST] ") and got["1"].endswith(" [/INST]" + prompts.TARGET_GREEN + "</s>")
    assert json.loads(got["2"].split("[/INST]")[1].removesuffix("</s>"))["label"] == 0
    assert text.sft_records(corpus, reviewed, max_rows=1).count() == 1


def test_parse_columns_keep_other_columns(spark):
    df = spark.createDataFrame([(1, '{"label": 1}')], "id int, judge_json string")
    assert text.judge_columns(df).columns == [
        "id", "judge_json", "llm_green_suggested", "llm_confidence", "llm_rationale", "parse_failed",
    ]
    assert text.resolve_label(df, "judge_json").select("id", "label", "ok").first() == (1, 1, True)


def test_json_is_parsed_once_per_row(spark):
    df = spark.createDataFrame([("{}",)], "reply string").select(F.concat("reply", F.lit("")).alias("reply"))
    plan = text.resolve_label(df)._jdf.queryExecution().optimizedPlan().toString()
    # One for the block, two for the whole text; not again for each column.
    assert plan.count("parseJson") + plan.count("try_parse_json") <= 4
