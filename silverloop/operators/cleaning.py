"""Projections, filters and cleaning: one pass, no shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from silverloop.contracts import require_columns
from silverloop.functions import labels

# The column names of the two working tables.
CORPUS_COLUMNS = ["id", "text", "is_green_silver", "split"]
REVIEW_COLUMNS = ["llm_green_suggested", "llm_confidence", "llm_rationale", "is_green_human", "human_notes"]


def prefix_columns(df: DataFrame, prefix: str) -> list[str]:
    """Names that start with ``prefix``; an error when there is none."""
    found = [c for c in df.columns if c.startswith(prefix)]
    if not found:
        raise ValueError(f"no column starts with {prefix!r}. Found: {df.columns}")
    return found


def select_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """The ``keep`` columns and every column whose name starts with ``prefix``."""
    return df.select(*keep, *prefix_columns(df, prefix))


def any_positive_label(df: DataFrame, prefix: str, out: str = "is_green_silver") -> DataFrame:
    """Add 1 where the prefix columns of a row sum to more than 0, else 0.

    Null counts as 0. The columns go through one array fold, so hundreds of
    indicator columns do not build a deep expression.
    """
    values = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in prefix_columns(df, prefix)])
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return df.withColumn(out, (total > 0).cast("int"))


def split_filter(df: DataFrame, value: str, column: str = "split", normalize: bool = False) -> DataFrame:
    """Rows of one split.

    The exact form reaches the scan as a pushed filter or a partition filter.
    ``normalize`` compares lower-cased, stripped text and cannot be pushed.
    """
    if normalize:
        return df.where(F.lower(labels.strip(F.col(column))) == value.strip().lower())
    return df.where(F.col(column) == value)


def project_rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Keep the columns in ``names`` (old to new), in that order."""
    require_columns(df, names)
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def coerce_binary(df: DataFrame, label: str = "label", text: str | None = "text") -> DataFrame:
    """Rows whose label is exactly 0 or 1, as int; text null becomes ``""``."""
    value = F.col(label)
    kind = df.schema[label].dataType
    # Numbers need no reading as text, and true and false are 1 and 0 when typed as such.
    if isinstance(kind, BooleanType):
        cleaned = df.where(value.isNotNull()).withColumn(label, value.cast("int"))
    elif isinstance(kind, NumericType):
        cleaned = df.where(value.isin(0, 1)).withColumn(label, value.cast("int"))
    else:
        cleaned = df.withColumn(label, labels.binary_label(value)).where(value.isNotNull())
    return text_or_empty(cleaned, text) if text else cleaned


def to_int01(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Add the 0/1/null reading of a dirty label column."""
    return df.withColumn(out or column, labels.to_int01(F.col(column)))


def clean_doc_id(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Add the normal text form of a document id column."""
    return df.withColumn(out or column, labels.clean_doc_id(F.col(column)))


def text_or_empty(df: DataFrame, column: str = "text", literal_null: bool = False) -> DataFrame:
    """Text column without nulls."""
    return df.withColumn(column, labels.text_or_empty(F.col(column), literal_null))


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with no null in ``columns``."""
    return df.na.drop(subset=list(columns))


def ensure_columns(df: DataFrame, defaults: Mapping[str, Any]) -> DataFrame:
    """Add the columns that are absent; those present stay as they are.

    A default is a plain value or a Column (for a typed null).
    """
    absent = {
        name: value if isinstance(value, Column) else F.lit(value)
        for name, value in defaults.items()
        if name not in df.columns
    }
    return df.withColumns(absent) if absent else df


def is_pending(label: Column, confidence: Column, rationale: Column) -> Column:
    """True until label, confidence and rationale are all filled in."""
    done = label.isin("0", "1") & (confidence != "") & (rationale != "")
    return ~F.coalesce(done, F.lit(False))


def pending_filter(
    df: DataFrame,
    label: str = "llm_green_suggested",
    confidence: str = "llm_confidence",
    rationale: str = "llm_rationale",
) -> DataFrame:
    """Rows still to be labelled."""
    return df.where(is_pending(F.col(label), F.col(confidence), F.col(rationale)))


def row_cap(df: DataFrame, n: int | None, position: str) -> DataFrame:
    """The first ``n`` rows by a unique position column; all rows for ``None``.

    Only positions go through the top-n step; the rows are then kept where they
    are by comparing with the last position taken.
    """
    if n is None:
        return df
    if n <= 0:
        return df.where(F.lit(False))
    last = df.select(position).where(F.col(position).isNotNull()).orderBy(position).limit(n)
    return df.where(F.col(position) <= last.agg(F.max(position)).scalar())
