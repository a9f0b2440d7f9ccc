"""A training corpus from raw documents: each stage keeps what the next one works on.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverloop.llm import common, decontaminate, langid, pieces, simhash, substrings

# A language has to be this likely.
MIN_SCORE = 0.5


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if not c.startswith("_")]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and a language the model is sure of; ``lang`` is what it was."""
    rejected = langid.filtered(docs, langid.train(docs), MIN_SCORE)
    return rejected.select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id."""
    return simhash.keep_one(docs).select(*_columns(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; untouched ones stay as they are, those without a word left go."""
    cut = substrings.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*_columns(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark")).select(*_columns(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document left, their number and whether they decode to its text."""
    vocabulary = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    back = pieces.encode_and_decode(docs, vocabulary)
    return back.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminated", decontaminated),
    ("encoded", encoded),
]

# Classifier, components and tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
