"""Vectors, fitted models and metrics kept between runs."""

from __future__ import annotations

import hashlib
import json

from pyspark.ml import PipelineModel
from pyspark.ml.base import Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _table_name(path: str) -> str:
    """The session's name of a bucketed store; the path is its identity."""
    return f"store_{hashlib.md5(path.rstrip('/').encode()).hexdigest()}"


def save_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """A table in files by hash of ``key``, sorted by it, for joins that don't shuffle it again.

    Tables saved with the same number of buckets join bucket by bucket. A null key goes
    to a bucket like any other. The path must be new. What the buckets are is written
    beside the files, so that any session can read them as such.
    """
    spark = df.sparkSession
    name = _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("error").saveAsTable(name)
    spec = spark.createDataFrame([(key, buckets, df.schema.json())], "key string, buckets int, columns string")
    spec.coalesce(1).write.json(f"{path.rstrip('/')}/_buckets")


def load_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``save_bucketed``, known to the planner as bucketed and sorted."""
    spec = spark.read.schema("key string, buckets int, columns string").json(f"{path.rstrip('/')}/_buckets").first()
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(spec.columns)))
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{spec.key}`) SORTED BY (`{spec.key}`) "
            f"INTO {spec.buckets} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)


def save_embeddings(
    df: DataFrame, path: str, key: str = "id", vector: str = "embedding", label: str | None = None, mode: str = "error", buckets: int | None = None
) -> None:
    """Vectors with their id (and label), in id order.

    Range partitions sorted by id give every row group a narrow id range, so a
    lookup of some ids skips most of them. With ``buckets`` they are files by hash of id
    instead, which ``load_embeddings`` and a join on the id read without a shuffle.
    """
    kept = df.select(key, F.col(vector).cast("array<float>").alias(vector), *([label] if label else []))
    if buckets:
        if mode != "error":
            raise ValueError("a bucketed store is written once, to a new path")
        save_bucketed(kept, path, key, buckets)
    else:
        kept.repartitionByRange(key).sortWithinPartitions(key).write.mode(mode).parquet(path)


def load_embeddings(spark: SparkSession, path: str, bucketed: bool = False) -> DataFrame:
    return load_bucketed(spark, path) if bucketed else spark.read.parquet(path)


def save_model(model: Transformer, path: str) -> None:
    """Save a fitted model; a lone stage is wrapped so that loading is uniform."""
    pipeline = model if isinstance(model, PipelineModel) else PipelineModel([model])
    pipeline.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


METRIC_COLUMNS = "section string, class string, metric string, value double, run string"


def append_metrics(rows: DataFrame, path: str) -> None:
    """Put a run's metric rows into the long metrics table, a folder per run.

    A run that is written again replaces its own rows and no others, so a retry leaves
    nothing twice.
    """
    (
        rows.select("section", "class", "metric", "value", "run")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run")
        .parquet(path)
    )


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All runs' rows; the name of a run is text, whatever it looks like."""
    return spark.read.schema(METRIC_COLUMNS).parquet(path)
