"""Checks that run before and beside a plan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df`` itself, or an error that lists what is missing and what is there."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}. Found: {df.columns}")
    return df


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """``df`` itself, or an error when it has no row. Reads at most one row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def check_contract(df: DataFrame, columns: Iterable[str], key: str | None = None) -> DataFrame:
    """Required columns now; row, null-key and repeated-key counts as one row later."""
    columns = list(columns)
    require_columns(df, columns + ([key] if key else []))
    if key is None:
        return df.agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) > 0).alias("has_rows"))
    per_key = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    extra = F.sum(F.when(F.col("_key").isNotNull(), F.col("_n") - 1))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("_key").isNull(), F.col("_n"))), F.lit(0)).alias("n_null_keys"),
        F.coalesce(extra, F.lit(0)).alias("n_duplicate_keys"),
        (F.coalesce(F.sum("_n"), F.lit(0)) > 0).alias("has_rows"),
    )
