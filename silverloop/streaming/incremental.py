"""Labelling that can stop at any point and go on without redoing rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from silverloop.operators.cleaning import REVIEW_COLUMNS, ensure_columns, pending_filter
from silverloop.operators.inference import COMMIT_PER_TASK, Generate, label_rows, written

_BATCH = "batch_id"


def _sink_schema(rows: DataFrame) -> StructType:
    full = ensure_columns(rows, {c: "" for c in REVIEW_COLUMNS})
    return StructType([*full.schema.fields]).add(_BATCH, LongType())


def pending(rows: DataFrame, key: str) -> DataFrame:
    """The rows still to be labelled, with all review columns; running it fails on a null key, which can't be found again."""
    full = ensure_columns(rows, {c: "" for c in REVIEW_COLUMNS})
    absent = F.raise_error(F.lit(f"null {key}")).cast(full.schema[key].dataType)
    full = full.withColumn(key, F.when(F.col(key).isNull(), absent).otherwise(F.col(key)))
    return pending_filter(full.na.fill("", REVIEW_COLUMNS))


def label_new(
    rows: DataFrame, make_model: Callable[[], Generate], key: str, text: str, done: DataFrame | None, tasks: int | None = None
) -> DataFrame:
    """Label the pending rows whose key is not in ``done``; a repeated key is labelled once.

    Of copies the one with the smallest hash of all it holds stands.
    """
    found = pending(rows, key)
    rest = [c for c in found.columns if c != key]
    first = F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_row")
    todo = found.groupBy(key).agg(first).select(*[key if c == key else f"_row.{c}" for c in found.columns])
    if done is not None:
        todo = todo.join(done.select(key), key, "left_anti")
    return label_rows(todo.repartition(tasks) if tasks else todo, make_model, text)


def label_incremental(
    stream: DataFrame,
    make_model: Callable[[], Generate],
    sink: str,
    checkpoint: str,
    key: str = "doc_id",
    text: str = "text",
) -> StreamingQuery:
    """Label what has arrived since the last run, then stop.

    The checkpoint remembers which files were read, and its state store every key that was
    labelled: a row whose key was in an earlier batch is dropped by a lookup of its own
    key, so a batch costs what its rows cost, however long the sink has become. Of copies in
    one batch one stands. Every micro-batch replaces its own folder of the sink, so a
    batch that is run again after a failure leaves no row twice. A sink belongs to its
    checkpoint: a new checkpoint over a sink that others have filled is an error.
    """
    fresh = pending(stream, key).dropDuplicates([key])
    schema = _sink_schema(stream)

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            there = written(batch.sparkSession, sink, schema)
            if there is not None and not there.where(F.col(_BATCH) != 0).isEmpty():
                raise ValueError(f"{sink} holds rows that this checkpoint does not know")
        label_rows(batch, make_model, text).write.mode("overwrite").parquet(f"{sink}/{_BATCH}={batch_id}")

    return (
        fresh.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def label_incremental_batch(
    rows: DataFrame, make_model: Callable[[], Generate], sink: str, key: str = "doc_id", text: str = "text", tasks: int | None = None
) -> None:
    """The same without a stream: label what the sink lacks and append it.

    Every task commits its rows as it ends, so a run that fails or is killed keeps them,
    and the next one labels the others only. ``tasks`` says how many the rows are dealt to.
    """
    done = written(rows.sparkSession, sink, _sink_schema(rows))
    last = -1 if done is None else done.agg(F.max(_BATCH)).first()[0]
    batch_id = 0 if last is None else last + 1
    made = label_new(rows, make_model, key, text, done, tasks)
    made.write.options(**COMMIT_PER_TASK).mode("append").parquet(f"{sink}/{_BATCH}={batch_id}")
