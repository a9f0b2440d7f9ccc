"""Whole rounds of the labelling loop, put together from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverloop.contracts import require_rows
from silverloop.operators.assembly import augment_append, augment_replace, eval_rows
from silverloop.operators.classify import predict_proba, retrain_eval
from silverloop.operators.cleaning import REVIEW_COLUMNS, any_positive_label, coerce_binary, ensure_columns
from silverloop.operators.joins import complement, embedding_align, gold_join, gold_matched
from silverloop.operators.sampling import class_sample, split_60_20_20, stratified_split, top_uncertain
from silverloop.operators.vectors import linear_score, uncertainty
from silverloop.session import stage_table


def silver_corpus(wide: DataFrame, prefix: str, per_class: int, key: str = "id", seed: int = 42) -> DataFrame:
    """Silver label from indicator columns, balanced sample, split column.

    The sample is written to the shared folder, so that the split does not go back
    to the wide table.
    """
    sample = class_sample(any_positive_label(wide, prefix), "is_green_silver", per_class, key, seed)
    return split_60_20_20(stage_table(sample, "sample"), key, seed)


def review_list(
    pool: DataFrame,
    vectors: DataFrame,
    model: PipelineModel | tuple[Sequence[float], float],
    k: int = 100,
    key: str = "id",
    vector_key: str = "id",
    on_missing: str = "error",
    texts: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` least certain rows of the pool with empty review columns.

    ``model`` is a fitted model, or its weights and intercept. A probability needs
    its vector only, so vectors are scored where they lie and one number per id is
    joined and ranked. Text is looked up for the ``k`` chosen ids. ``texts`` is the table it is read from; give the plain corpus where
    the pool is itself a join, so that the join is not run on whole texts.
    """
    if isinstance(model, PipelineModel):
        scored = predict_proba(vectors.select(vector_key, "embedding"), model)
    else:
        scored = linear_score(vectors.select(vector_key, "embedding"), *model, prediction=None)
    # one number per id, stored once: the check for repeated ids reads it too, and must not make vectors again
    scored = stage_table(scored.select(vector_key, "p_green"), "scores")
    aligned = embedding_align(pool.select(key), scored, key, vector_key, "p_green", on_missing)
    top = top_uncertain(uncertainty(aligned), k, tie=key)
    listed = (pool if texts is None else texts).select(key, "text").join(top, key)
    return ensure_columns(
        listed.select(F.col(key).alias("doc_id"), "text", "p_green", "u"), dict.fromkeys(REVIEW_COLUMNS, "")
    )


def unlabelled(documents: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents nobody has labelled."""
    return complement(documents, labels, key)


def replace_round(corpus: DataFrame, gold: DataFrame, run: str, **how) -> tuple[PipelineModel, DataFrame]:
    """Retrain with reviewed labels in place of silver ones; metrics on the evaluation split.

    ``how`` goes to ``retrain_eval``: an encoder or a pipeline.
    """
    require_rows(gold_matched(gold_join(corpus.select("id"), gold)), "no reviewed id is in the corpus")
    return retrain_eval(augment_replace(corpus, gold), eval_rows(corpus), run, **how)


def append_round(
    corpus: DataFrame, reviewed: DataFrame, label: str, run: str, **how
) -> tuple[PipelineModel, DataFrame]:
    """Retrain with reviewed rows added; metrics on the evaluation split."""
    require_rows(coerce_binary(reviewed, label, text=None), f"no reviewed row has a valid {label}")
    return retrain_eval(augment_append(corpus, reviewed, label), eval_rows(corpus), run, **how)


def stratified_round(reviewed: DataFrame, key: str, run: str, **how) -> tuple[PipelineModel, DataFrame]:
    """Train and test on the reviewed rows alone, class balance kept."""
    parts = stratified_split(reviewed, "label", key)
    return retrain_eval(parts.where(F.col("part") == "train"), parts.where(F.col("part") == "test"), run, **how)
