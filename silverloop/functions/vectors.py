"""Arithmetic on array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of the same length."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)


def weights_literal(weights: Sequence[float]) -> Column:
    """A constant ``ARRAY<DOUBLE>`` column."""
    return F.array(*[F.lit(float(w)) for w in weights])


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def linear_probability(vec: Column, weights: Sequence[float], intercept: float) -> Column:
    """P(class 1) of a fitted linear model given by its numbers."""
    return sigmoid(dot(vec, weights_literal(weights)) + F.lit(float(intercept)))


def uncertainty(p: Column) -> Column:
    """1 at p = 0.5, falling to 0 at p = 0 and p = 1."""
    return F.lit(1.0) - F.lit(2.0) * F.abs(p - F.lit(0.5))


def argmax(scores: Column) -> Column:
    """Index of the largest score, the first one on a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
