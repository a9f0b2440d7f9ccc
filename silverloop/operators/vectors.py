"""Scores and pooling on vectors kept in array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverloop.functions import vectors

# Fixed value: the least mask sum that a pooled vector is divided by.
MASK_FLOOR = 1e-9


def uncertainty(df: DataFrame, p: str = "p_green", out: str = "u") -> DataFrame:
    """Add how close a probability is to 0.5."""
    return df.withColumn(out, vectors.uncertainty(F.col(p)))


def linear_score(
    df: DataFrame,
    weights: Sequence[float],
    intercept: float = 0.0,
    vector: str = "embedding",
    probability: str = "p_green",
    prediction: str | None = "prediction",
) -> DataFrame:
    """Add P(class 1), and the class at threshold 0.5, of a model given by its numbers."""
    scored = df.withColumn(probability, vectors.linear_probability(F.col(vector), weights, intercept))
    if prediction:
        scored = scored.withColumn(prediction, (F.col(probability) > 0.5).cast("int"))
    return scored


def argmax_label(df: DataFrame, scores: str = "scores", out: str = "label") -> DataFrame:
    """Add the index of the largest score, the first one on a tie."""
    return df.withColumn(out, vectors.argmax(F.col(scores)))


def masked_mean_pool(
    df: DataFrame, key: str = "doc_id", mask: str = "mask", vector: str = "vec", out: str = "pooled"
) -> DataFrame:
    """Mean of the token vectors whose mask is 1, per document.

    One aggregate with map-side sums of whole vectors: a document with any number
    of tokens sends one partial sum per task.
    """
    weight = F.col(mask).cast("double")
    masked = F.transform(F.col(vector), lambda x: x.cast("double") * weight)
    pooled = df.groupBy(key).agg(
        vector_to_array(Summarizer.sum(array_to_vector(masked))).alias("_sum"), F.sum(weight).alias("_mask")
    )
    divisor = F.greatest(F.col("_mask"), F.lit(MASK_FLOOR))
    return pooled.select(key, F.transform("_sum", lambda x: x / divisor).alias(out))
