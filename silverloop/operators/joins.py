"""Equi-joins of the labelling loop.

No side is hinted: Catalyst broadcasts a side only when its size estimate or its
measured size is under ``spark.sql.autoBroadcastJoinThreshold``. Beyond that the
join shuffles, and adaptive execution splits a hot key of the left side, which
is safe because every right side here has one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverloop.contracts import require_columns
from silverloop.functions import labels
from silverloop.operators.sampling import dedupe_keep_last


def _join_id(c: Column, normalize: bool) -> Column:
    return labels.clean_doc_id(c) if normalize else labels.strip(c.cast("string"))


def clean_gold(
    gold: DataFrame, key: str = "doc_id", label: str = "is_green_human", position: str = "source_pos"
) -> DataFrame:
    """Reviewed labels as (``gold_id``, ``human``): valid ids and labels, last row per id."""
    require_columns(gold, [key, label, position])
    typed = gold.select(
        labels.clean_doc_id(F.col(key)).alias("gold_id"),
        labels.binary_label(F.col(label)).alias("human"),
        F.col(position).alias("gold_pos"),
    ).where(F.col("gold_id").isNotNull() & F.col("human").isNotNull())
    return dedupe_keep_last(typed, "gold_id", "gold_pos").select("gold_id", "human")


def gold_join(
    corpus: DataFrame,
    gold: DataFrame,
    key: str = "id",
    normalize: bool = True,
    out: str = "is_green_human",
    **gold_columns: str,
) -> DataFrame:
    """The corpus with the human label where there is one; rows never multiply.

    ``normalize=False`` compares the stripped corpus id as it stands.
    """
    human = clean_gold(gold, **gold_columns).withColumnRenamed("human", out)
    # The key is a column of its own, so that it is worked out once per row and not
    # again in the exchange, the sort and the join.
    keyed = corpus.withColumn("_gid", _join_id(F.col(key), normalize))
    return keyed.join(human, F.col("_gid") == F.col("gold_id"), "left").drop("_gid", "gold_id")


def gold_override(
    joined: DataFrame, human: str = "is_green_human", silver: str = "is_green_silver", out: str = "is_green_gold"
) -> DataFrame:
    """Final label: human where present, else silver read as a 0/1 label."""
    return joined.withColumn(out, F.coalesce(F.col(human), labels.binary_label(F.col(silver))))


def gold_matched(joined: DataFrame, human: str = "is_green_human") -> DataFrame:
    """Rows with a human label, of any split."""
    return joined.where(F.col(human).isNotNull())


def exclude_ids(
    df: DataFrame, ids: DataFrame, key: str = "id", ids_key: str = "doc_id", normalize: bool = True
) -> DataFrame:
    """Rows whose id is not in ``ids``; null ids on either side match nothing."""
    # Distinct, so that copies of one listed id are folded before the shuffle.
    listed = ids.select(_join_id(ids[ids_key], normalize).alias("_id")).where(F.col("_id").isNotNull()).distinct()
    keyed = df.withColumn("_key", _join_id(F.col(key), normalize))
    return keyed.join(listed, F.col("_key") == F.col("_id"), "left_anti").drop("_key")


def complement(df: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` that were not drawn into ``sample``; both have one row per key."""
    return df.join(sample.select(key), key, "left_anti")


def embedding_align(
    df: DataFrame,
    vectors: DataFrame,
    key: str = "id",
    vector_key: str = "id",
    vector: str = "embedding",
    on_missing: str = "error",
) -> DataFrame:
    """Attach a vector to every row by id.

    A repeated vector id fails the run. A row without a vector fails it too, gets a null
    one with ``on_missing='null'``, or is left out with ``'drop'``. Ids alone are counted;
    vectors are not grouped, and those of a bucketed store are not shuffled.
    """
    if on_missing not in ("error", "drop", "null"):
        raise ValueError(f"on_missing must be 'error', 'drop' or 'null', not {on_missing!r}")
    twice = vectors.groupBy(vector_key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeated = twice.agg(F.min(vector_key).cast("string")).scalar()
    kind = vectors.schema[vector].dataType
    named = vectors.select(F.col(vector_key).alias("_vid"), F.col(vector).alias("_vector"))
    joined = df.join(named, F.col(key) == F.col("_vid"), "inner" if on_missing == "drop" else "left")
    copies = F.raise_error(F.concat(F.lit("more than one vector for id "), repeated)).cast(kind)
    absent = F.raise_error(F.concat(F.lit("no vector for id "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(kind)
    checked = F.when(repeated.isNotNull(), copies)
    if on_missing == "error":
        checked = checked.when(F.col("_vid").isNull(), absent)
    checked = checked.otherwise(F.col("_vector"))
    return joined.withColumn(vector, checked).drop("_vid", "_vector")


def token_lookup(
    sentences: DataFrame,
    words: DataFrame,
    tokens: str = "tokens",
    word: str = "word",
    vector: str = "vec",
    on_unknown: str = "error",
) -> DataFrame:
    """One row per token with its position and word vector.

    ``on_unknown``: ``error`` fails the run at a word without a vector, ``keep``
    gives it a null vector, ``drop`` leaves it out.
    """
    if on_unknown not in ("error", "keep", "drop"):
        raise ValueError(f"on_unknown must be 'error', 'keep' or 'drop', not {on_unknown!r}")
    rest = [c for c in sentences.columns if c != tokens]
    flat = sentences.select(*rest, F.posexplode(tokens).alias("pos", "token"))
    known = words.select(F.col(word).alias("_word"), F.col(vector).alias("vec"))
    joined = flat.join(known, F.col("token") == F.col("_word"), "inner" if on_unknown == "drop" else "left")
    if on_unknown == "error":
        unknown = F.raise_error(F.concat(F.lit("unknown word: "), F.col("token")))
        cast = unknown.cast(words.schema[vector].dataType)
        joined = joined.withColumn("vec", F.when(F.col("_word").isNull(), cast).otherwise(F.col("vec")))
    return joined.drop("_word")
