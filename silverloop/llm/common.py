"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverloop.session import new_path, stage_table

# Code points one step of a task works on at a time; a longer text is a step of its own.
CHUNK_CHARS = 2_000_000
# Rows of one Arrow batch: whole texts are long, so batches are kept short.
BATCH_ROWS = "1000"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share."""
    return new_path(spark, f"llm-{name}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files, which survive lost executors."""
    return stage_table(df, f"llm-{name}")


def texts_of(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """Only the columns an operator needs, under names of its own; null text is empty."""
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *more)


def chunks(batch: pa.RecordBatch, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of a batch with about ``limit`` bytes of text each, and their texts."""
    column = batch.column(batch.schema.get_field_index("_text"))
    sizes = np.cumsum(pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(sizes):
        base = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield first, last, column.slice(first, last - first).to_pylist()
        first = last


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """A stream sorted by ``key`` in tables of about ``rows`` rows that part no group of equal keys."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            values = table.column(key).to_numpy()
            cut = int(np.searchsorted(values, values[-1], side="left"))
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            n -= cut
    if n:
        yield pa.Table.from_batches(held)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every (start, length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
