"""A gradient fold in row order, spread over the cluster.

One step of the one-weight model, w' = w - r * 2x(xw - t), is the affine map
w' = (1 - 2rx^2) w + 2rxt. Maps compose, so a prefix of rows is one map and many rows are
traced at once. Rows are dealt to ranges of (key, position), about equally many to each,
whatever the keys: a key with most of the rows lies over most of the ranges. A range is
reduced to what it makes of the weight that comes in; these functions are scanned in a
tree, ``FAN`` of them to a node, up and down again, and each range then traces its rows
from the weight that reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverloop.session import shared_dir

# Learning rate and first weight.
ALPHA = 1e-6
FIRST_WEIGHT = 0.5

# Ranges that one node of the tree composes.
FAN = 4096


def prefix_maps(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Composition of all maps up to each place, w -> a w + b, anew where ``first`` is true; all places at once."""
    a, b = a.astype(float).copy(), b.astype(float).copy()
    start = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
    reach, longest = 1, int((np.arange(len(a)) - start).max(initial=0)) + 1
    place = np.arange(len(a)) - start
    while reach < longest:
        i = np.flatnonzero(place >= reach)
        # the right side is read whole before it is written
        a[i], b[i] = a[i] * a[i - reach], a[i] * b[i - reach] + b[i]
        reach *= 2
    return a, b


def _new(keys: np.ndarray) -> np.ndarray:
    return np.append(True, keys[1:] != keys[:-1])


def _steps(batch: pd.DataFrame, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, t = batch["x"].to_numpy(), batch["t"].to_numpy()
    return 1.0 - 2.0 * alpha * x * x, 2.0 * alpha * x * t, batch["key"].to_numpy()


def _range_maps(alpha: float, w0: float):
    """Batch function over the sorted rows of ranges: what a range makes of the weight that comes in.

    A row per range: its first and last key, and the map from the weight before it to the
    weight after it. Where it holds several keys, that is a constant.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None  # [range, first key, last key, a, b]
        for batch in batches:
            if not len(batch):
                continue
            for part, rows in batch.groupby("range", sort=False):  # a batch may reach over ranges
                a, b, keys = _steps(rows, alpha)
                new = _new(keys)
                a, b = prefix_maps(a, b, new)
                if now is not None and now[0] != part:
                    yield pd.DataFrame([now], columns=_NODE)
                    now = None
                if now is None:
                    now = [part, keys[0], keys[0], 1.0, 0.0]
                if new[1:].any() or keys[0] != now[2]:
                    now[2:] = [keys[-1], 0.0, a[-1] * w0 + b[-1]]
                else:
                    now[3:] = [a[-1] * now[3], a[-1] * now[4] + b[-1]]
        if now is not None:
            yield pd.DataFrame([now], columns=_NODE)

    return run


_NODE = ["range", "first", "last", "a", "b"]


def _joined(nodes: pd.DataFrame, w0: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For nodes in order: whether each goes on with the key before it, and the map from what comes into the
    first one to what leaves each."""
    first, last = nodes["first"].to_numpy(), nodes["last"].to_numpy()
    a, b = nodes["a"].to_numpy(), nodes["b"].to_numpy()
    on = np.append(True, first[1:] == last[:-1])
    # a key that begins here begins with the first weight, whatever came before
    a, b = np.where(on, a, 0.0), np.where(on, b, a * w0 + b)
    # nothing before a constant counts, be it no number
    head = a == 0.0
    head[:1] = True
    a, b = prefix_maps(a, b, head)
    return on, a, b


def _up(w0: float):
    """One node of the nodes under it, which are sorted."""

    def run(_: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("range", ignore_index=True)
        _, a, b = _joined(nodes, w0)
        return pd.DataFrame([[nodes["node"].iat[0], nodes["first"].iat[0], nodes["last"].iat[-1], a[-1], b[-1]]], columns=_NODE)

    return run


def _down(w0: float):
    """The weight that comes into each of the nodes under one, by the weight that comes into that."""

    def run(_: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("range", ignore_index=True)
        on, a, b = _joined(nodes, w0)
        w = nodes["w"].iat[0]
        left = np.append(w, np.where(a == 0.0, b, a * w + b)[:-1])
        return pd.DataFrame({"range": nodes["range"], "w": np.where(on, left, w0)})

    return run


def incoming_weights(maps: DataFrame, w0: float, fan: int = FAN) -> DataFrame:
    """``range``, ``w``: the weight before each range, by a scan in levels of ``fan`` nodes each.

    A level is a grouped step; no group holds more than ``fan`` rows, however many ranges
    a key lies over.
    """
    highest = maps.agg(F.max("range")).first()[0]
    levels, n = [maps], 0 if highest is None else highest + 1
    kinds = {c: maps.schema[c].dataType.simpleString() for c in ("first", "last")}
    node = F.expr(f"`range` div {fan}")
    while n > fan:
        above = levels[-1].withColumn("node", node).groupBy("node")
        levels.append(above.applyInPandas(_up(w0), f"range bigint, first {kinds['first']}, last {kinds['last']}, a double, b double"))
        n = -(-n // fan)
    found = None
    for level in reversed(levels):
        level = level.withColumn("node", node if found is not None else F.lit(0).cast("bigint"))
        if found is None:
            level = level.withColumn("w", F.lit(float(w0)))
        else:
            level = level.join(found.select(F.col("range").alias("node"), "w"), "node")
        found = level.groupBy("node").applyInPandas(_down(w0), "range bigint, w double")
    return found


def _row_weights(alpha: float, w0: float, incoming: dict[int, float]):
    """Batch function over the sorted rows of ranges: the weight before each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, key, w = None, None, w0
        for batch in batches:
            if not len(batch):
                continue
            for part, rows in batch.groupby("range", sort=False):
                a, b, keys = _steps(rows, alpha)
                if part != now:
                    now, key, w = part, keys[0], incoming[part]
                new = _new(keys)
                a, b = prefix_maps(a, b, new)
                start = np.where(np.cumsum(new) > 1, w0, w if keys[0] == key else w0)
                after = a * start + b
                before = np.where(new, start, np.append(w0, after[:-1]))
                key, w = keys[-1], after[-1]
                yield rows[["key", "pos", "x", "t"]].assign(w_old=before)

    return run


def _present(column: Column, name: str, kind: str) -> Column:
    """The value; running it fails where it is null."""
    return F.when(column.isNull(), F.raise_error(F.lit(f"null {name}")).cast(kind)).otherwise(column)


def sgd_trace(
    df: DataFrame,
    key: str,
    pos: str,
    x: str = "x",
    t: str = "t",
    alpha: float = ALPHA,
    w0: float = FIRST_WEIGHT,
    first_n: int | None = None,
    ranges: int | None = None,
    fan: int = FAN,
) -> DataFrame:
    """Per key, in order of ``pos``: ``w_old, prediction, loss, gradient, w_new``.

    Equal positions of a key go by ``x``, then ``t``. A null key or position has no place in
    any order: running the trace fails on one. A null ``x`` or ``t`` makes that row's and all
    later weights of its key null. ``first_n`` keeps the first rows of every key only.
    Rows are dealt to ``ranges`` ranges, as many as Spark finds right unless given, and
    kept there by a checkpoint, since both passes must see the same ranges. An empty
    table gives an empty result.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(
        _present(F.col(key), key, kind).alias("key"),
        _present(F.col(pos).cast("bigint"), pos, "bigint").alias("pos"),
        F.col(x).cast("double").alias("x"),
        F.col(t).cast("double").alias("t"),
    )
    if first_n is not None:
        ranked = F.row_number().over(Window.partitionBy("key").orderBy("pos", "x", "t"))
        rows = rows.withColumn("rank", ranked).where(F.col("rank") <= first_n).drop("rank")
    order = ["key", "pos", "x", "t"]
    dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    placed = dealt.sortWithinPartitions(*order).withColumn("range", F.spark_partition_id().cast("bigint")).checkpoint()
    maps = placed.mapInPandas(_range_maps(alpha, w0), f"range bigint, first {kind}, last {kind}, a double, b double")
    # one number per range; there are as many ranges as tasks
    incoming = {r.range: r.w for r in incoming_weights(maps.checkpoint(), w0, fan).collect()}
    incoming = {k: np.nan if w is None else w for k, w in incoming.items()}
    traced = placed.mapInPandas(_row_weights(alpha, w0, incoming), f"key {kind}, pos bigint, x double, t double, w_old double")
    prediction = F.col("x") * F.col("w_old")
    gradient = 2 * F.col("x") * (prediction - F.col("t"))
    return traced.select(
        F.col("key").alias(key),
        F.col("pos").alias(pos),
        "x",
        "t",
        "w_old",
        prediction.alias("prediction"),
        F.pow(F.col("t") - prediction, F.lit(2)).alias("loss"),
        gradient.alias("gradient"),
        (F.col("w_old") - F.lit(alpha) * gradient).alias("w_new"),
    )
