"""SimHash near-duplicates: fingerprints, BK-trees over shards, connected classes.

Fingerprints that differ in at most r bits agree exactly in b - r of b blocks of
bits. Each choice of b - r blocks deals the distinct fingerprints to shards by the
bits chosen, so a pair within the radius meets in some shard, whatever the other
bits are. In a shard a BK-tree is built (children keyed by their distance to the
parent) and all of the shard's fingerprints walk it together, following only edges
within the radius. A shard reports a spanning forest of its links and not all pairs,
so a group of n near copies makes n - 1 rows. ``b`` is the smallest number of blocks
with which no shard is larger than ``SHARD_ROWS``; it changes the work, not the
result. Shards reach their tasks by a shuffle: their number grows with the corpus, so
they are not broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverloop.llm.common import chunks, runs, stage, texts_of, whole_groups

BITS = 64
SHINGLE = 4
SEED = 42
# Hashes whose bits are counted at once, 64 bytes each.
HASHES_AT_ONCE = 300_000
RADIUS = 4
# A shard of this size takes seconds; more blocks are used before shards get larger.
SHARD_ROWS = 20_000
MAX_BLOCKS = 8


def _fingerprints(texts: list[str], shingle: int) -> np.ndarray:
    ones, counts = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    whose: list[int] = []
    many: list[int] = []

    def count() -> None:
        if hashes:
            sets = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones[whose] += np.add.reduceat(sets, np.cumsum([0, *many[:-1]]), axis=0, dtype=np.int64)
            np.add.at(counts, whose, many)
        for x in (hashes, whose, many):
            x.clear()

    for i, text in enumerate(texts):
        words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts
        if not words:
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.append(0, ends[:-1])
        last = (ends - 1)[min(shingle, len(words)) - 1 :]
        for k in range(0, len(last), HASHES_AT_ONCE):
            part = slice(k, min(k + HASHES_AT_ONCE, len(last)))
            new = [digest(line[a:b], SEED) for a, b in zip(starts[part].tolist(), last[part].tolist(), strict=True)]
            hashes.extend(new)
            whose.append(i)
            many.append(len(new))
            if len(hashes) >= HASHES_AT_ONCE:
                count()
    count()
    return np.packbits((ones * 2 > counts[:, None]).astype(np.uint8), axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``_id`` and ``fp`` (the 64 bits as a bigint) of every row.

    A null text, or one of white space only, has no words and fingerprint 0; one of
    fewer words than a shingle is a shingle as a whole.
    """
    rows = texts_of(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("_id"))
            for first, last, texts in chunks(batch, 1_000_000):
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(_fingerprints(texts, shingle).view(np.int64))], ["_id", "fp"])

    return rows.mapInArrow(run, f"_id {kind}, fp bigint")


def bk_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``radius`` among distinct values, by a BK-tree.

    The tree is made and walked node by node: each node holds the values below it
    and the queries that reach it, both as arrays.
    """
    label = np.arange(len(values))
    left, right = [], []
    stack = [(np.arange(len(values)), np.arange(len(values)))]
    while stack:
        below, queries = stack.pop()
        node, below = below[0], below[1:]
        apart = np.bitwise_count(values[queries] ^ values[node]).astype(np.int64)
        near = queries[(apart <= radius) & (label[queries] != label[node])]
        if len(near):
            found, at = np.unique(label[near], return_index=True)
            left += [values[node]] * len(at)
            right += values[near[at]].tolist()
            label[np.isin(label, found)] = label[node]
        if not len(below):
            continue
        edge = np.bitwise_count(values[below] ^ values[node]).astype(np.int64)
        order = np.argsort(edge, kind="stable")
        below, edge = below[order], edge[order]
        cuts = np.flatnonzero(np.append(True, edge[1:] != edge[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(edge)), strict=True):
            reach = queries[np.abs(apart - edge[a]) <= radius]
            if len(reach):
                stack.append((below[a:b], reach))
    return np.array(left, np.uint64), np.array(right, np.uint64)


def _shards(nodes: DataFrame, blocks: int, radius: int) -> DataFrame:
    """Each fingerprint once per choice of ``blocks - radius`` blocks: ``choice``, ``bits``, ``fp``."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = []
    for kept in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in kept)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])
    return nodes.select("fp", F.explode(keys).alias("k")).select("k.choice", "k.bits", "fp")


def links(nodes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``u``, ``v``: links that connect what all pairs of distinct ``fp`` within ``radius`` connect."""
    for blocks in range(radius + 1, MAX_BLOCKS + 1):
        sharded = _shards(nodes, blocks, radius)
        if blocks == MAX_BLOCKS or (sharded.groupBy("choice", "bits").count().agg(F.max("count")).first()[0] or 0) <= shard_rows:
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bits", 100_000):
            choice, bits, fp = (table.column(c).to_numpy() for c in ("choice", "bits", "fp"))
            starts = runs(bits, choice)
            found = [bk_links(fp[a:b].view(np.uint64), radius) for a, b in zip(starts, np.append(starts[1:], len(fp)), strict=True) if b - a > 1]
            if found:
                u, v = (pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([u, v], ["u", "v"])

    return sharded.repartition("choice", "bits").sortWithinPartitions("bits", "choice").mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node``, ``root`` (smallest reachable) for every end of an edge.

    Large-star and small-star steps in turn, each a grouped minimum and a join, until
    the edges are stars. Every round is written to the shared folder.
    """
    edges = stage(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), name)
    size = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    before = None
    while (now := tuple(edges.agg(*size).first())) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        large = stage(large, name)
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a <> b")
        edges = stage(small.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), name)
    return edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))


def _rooted(marked: DataFrame, radius: int) -> DataFrame:
    """``fp``, ``low`` (smallest ``_id`` of that print) and ``root`` (the same all over a class) of every distinct print."""
    nodes = stage(marked.groupBy("fp").agg(F.min("_id").alias("low")), "simhash-nodes")
    roots = components(links(nodes, radius), "simhash-links")
    return nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``id_col``, ``fp``, ``component_id`` (smallest id reachable, itself included) for every row.

    Repeated rows give repeated rows with one class. A null id is larger than any
    other; a class of null ids only has a null ``component_id``. An empty table gives
    an empty result.
    """
    marked = stage(fingerprints(docs, id_col, text_col, shingle), "simhash")
    rooted = _rooted(marked, radius)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of_print = rooted.join(lowest, "root").select("fp", "component_id")
    return marked.join(of_print, "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each class, whatever the ids: that with the smallest id.

    A null id is larger than any other. Rows of one id, or of null ids, are told apart
    by a hash of all they hold, then by one of their text, so a task that runs again
    chooses the same row; equal rows are one.
    """
    # a null leaves a hash as it is, so where the nulls are is hashed too
    held = F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns]).alias("_key")
    keyed = docs.select(held, F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("_sum"), F.struct("*").alias("_row"))
    own = F.col("_row")[id_col]
    place = F.struct(own.isNull().alias("none"), own.alias("id"), "_key", "_sum").alias("_place")
    marked = stage(fingerprints(keyed.select(place, F.col("_row")[text_col].alias("_body")), "_place", "_body"), "simhash")
    lows = _rooted(marked, RADIUS).groupBy("root").agg(F.min("low").alias("low")).select("low._key", "low._sum")
    # copies fold before they are shuffled, so many equal rows don't meet in one task
    return keyed.dropDuplicates(["_key", "_sum"]).join(lows, ["_key", "_sum"], "left_semi").select("_row.*")
