"""Training sets from silver and reviewed labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverloop.contracts import require_columns
from silverloop.operators.cleaning import CORPUS_COLUMNS, coerce_binary, project_rename, split_filter
from silverloop.operators.joins import gold_join, gold_matched, gold_override


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Bag union by column name; a column one side lacks is null there."""
    out = first
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def augment_replace(
    corpus: DataFrame,
    gold: DataFrame,
    train_split: str = "train_silver",
    normalize: bool = True,
    **gold_columns: str,
) -> DataFrame:
    """Training rows (``text``, ``label``): silver train rows, reviewed rows replaced.

    A reviewed row counts once, with its human label, from whichever split it
    comes. "Train without reviewed ids, plus reviewed rows" is one filter on the
    joined corpus, so the corpus is read once.
    """
    require_columns(corpus, CORPUS_COLUMNS)
    labelled = gold_override(gold_join(corpus, gold, normalize=normalize, **gold_columns))
    used = labelled.where(F.col("is_green_human").isNotNull() | (F.col("split") == train_split))
    return coerce_binary(used.select("text", F.col("is_green_gold").alias("label")))


def eval_rows(
    corpus: DataFrame,
    eval_split: str = "eval_silver",
    gold: DataFrame | None = None,
    exclude_eval_gold: bool = False,
    normalize: bool = True,
) -> DataFrame:
    """Evaluation rows (``text``, ``label``) with silver labels.

    Reviewed rows stay in unless ``exclude_eval_gold`` takes them out, which
    keeps a reviewed evaluation row from being trained and tested on.
    """
    require_columns(corpus, ["text", "is_green_silver", "split"])
    rows = split_filter(corpus, eval_split)
    if exclude_eval_gold:
        if gold is None:
            raise ValueError("exclude_eval_gold needs the gold table")
        rows = gold_join(rows, gold, normalize=normalize).where(F.col("is_green_human").isNull())
    return coerce_binary(rows.select("text", F.col("is_green_silver").alias("label")))


def eval_gold_overlap(corpus: DataFrame, gold: DataFrame, eval_split: str = "eval_silver") -> DataFrame:
    """How many evaluation rows also have a human label."""
    both = gold_matched(gold_join(split_filter(corpus, eval_split), gold))
    return both.agg(F.count(F.lit(1)).alias("eval_gold_rows"))


def augment_append(
    corpus: DataFrame,
    reviewed: DataFrame,
    label: str = "is_green_human_2",
    train_split: str = "train_silver",
) -> DataFrame:
    """Training rows: the silver train split with the reviewed rows added as they are."""
    require_columns(corpus, ["text", "is_green_silver", "split"])
    require_columns(reviewed, ["text", label])
    train = split_filter(corpus, train_split).select("text", F.col("is_green_silver").alias("label"))
    extra = project_rename(reviewed, {"text": "text", label: "label"})
    return union_all(coerce_binary(train), coerce_binary(extra))
