"""Self-attention as joins and aggregates.

The tokens of a sentence are packed into blocks, and the n blocks of a sentence into a
grid of about sqrt(n) x sqrt(n) cells. A block of queries goes to every cell of its row,
a block of keys to every cell of its column, and blocks meet in an equi-join on the cell:
vectors are shuffled sqrt(n) times and not n times. A long sentence spreads over as many
join keys as it has cells, a row never holds more than one block, and the n x n scores
are kept as arrays of one block each. Results that are linear in the tokens (context
vectors, the best keys) are merged inside a cell before a second shuffle brings the
cells of a query together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silverloop.functions.vectors import dot

BLOCK = 32


def _blocks(tokens: DataFrame, sentence: str, pos: str, vector: str, block: int) -> DataFrame:
    """(sentence, block, items): the tokens of each block in order."""
    item = F.struct(F.col(pos).cast("bigint").alias("pos"), F.col(vector).cast("array<double>").alias("vec"))
    return tokens.groupBy(F.col(sentence).alias("sentence"), F.expr(f"cast({pos} as bigint) div {block}").alias("block")).agg(
        F.sort_array(F.collect_list(item)).alias("items")
    )


def _grid(tokens: DataFrame, sentence: str, pos: str, vector: str, block: int) -> DataFrame:
    """(sentence, row, col, q_block, queries, k_block, keys): every two blocks of a sentence, in their cell."""
    blocks = _blocks(tokens, sentence, pos, vector, block)
    ends = tokens.groupBy(F.col(sentence).alias("sentence")).agg(
        F.expr(f"cast(min({pos}) as bigint) div {block}").alias("lo"),
        F.expr(f"cast(max({pos}) as bigint) div {block}").alias("hi"),
    )
    n = F.col("hi") - F.col("lo") + 1
    side = F.ceil(F.sqrt(n)).cast("bigint")
    placed = blocks.join(ends, "sentence").withColumn("side", side)
    placed = placed.withColumn("own", F.expr("(block - lo) * side div (hi - lo + 1)"))
    cells = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("side") - 1))
    queries = placed.select("sentence", F.col("own").alias("row"), cells.alias("col"), F.col("block").alias("q_block"), F.col("items").alias("queries"))
    keys = placed.select("sentence", cells.alias("row"), F.col("own").alias("col"), F.col("block").alias("k_block"), F.col("items").alias("keys"))
    return queries.join(keys, ["sentence", "row", "col"])


def _scored(tokens: DataFrame, sentence: str, pos: str, vector: str, block: int) -> DataFrame:
    """(sentence, row, col, q_pos, k_block, scores, keys) for every query and key block."""
    row = F.transform(
        "queries",
        lambda q: F.struct(
            q["pos"].alias("q_pos"), F.transform("keys", lambda k: dot(q["vec"], k["vec"])).alias("scores")
        ),
    )
    met = _grid(tokens, sentence, pos, vector, block)
    return met.select("sentence", "row", "col", "k_block", "keys", F.explode(row).alias("r")).select(
        "sentence", "row", "col", F.col("r.q_pos").alias("q_pos"), "k_block", F.col("r.scores").alias("scores"), "keys"
    )


def attention_scores(
    tokens: DataFrame, sentence: str = "sentence", pos: str = "pos", vector: str = "vec", block: int = BLOCK
) -> DataFrame:
    """Unscaled dot products: per query and key block, one score per key in order."""
    return _scored(tokens, sentence, pos, vector, block).drop("keys", "row", "col")


def _weighted(scored: DataFrame) -> DataFrame:
    """Scores to softmax weights; the blocks of one query share one shuffle."""
    per_query = Window.partitionBy("sentence", "q_pos")
    shifted = scored.withColumn("top", F.max(F.array_max("scores")).over(per_query)).withColumn(
        "e", F.transform("scores", lambda s: F.exp(s - F.col("top")))
    )
    block_sum = F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x)
    total = shifted.withColumn("total", F.sum(block_sum).over(per_query))
    return total.withColumn("weights", F.transform("e", lambda x: x / F.col("total"))).drop("scores", "top", "e", "total")


def attention_weights(
    tokens: DataFrame, sentence: str = "sentence", pos: str = "pos", vector: str = "vec", block: int = BLOCK
) -> DataFrame:
    """Softmax of the scores of each query, shifted by the query's maximum."""
    return _weighted(attention_scores(tokens, sentence, pos, vector, block))


def _local(tokens: DataFrame, sentence: str, pos: str, vector: str, block: int) -> DataFrame:
    """Per query and key block: the top score, the scores' exponentials below it (``e``) and their sum (``mass``)."""
    scored = _scored(tokens, sentence, pos, vector, block).withColumn("top", F.array_max("scores"))
    local = scored.withColumn("e", F.transform("scores", lambda s: F.exp(s - F.col("top"))))
    return local.withColumn("mass", F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x))


def _merged(parts: DataFrame, keys: list[str], merge) -> DataFrame:
    """Partial results of one query (``top``, ``mass``, ``part``) as one: masses and parts are brought to the highest top.

    ``merge`` takes the struct's array and gives its ``part``; it may use ``scale`` of each.
    """
    found = parts.groupBy(*keys).agg(F.collect_list(F.struct("top", "mass", "part")).alias("p"))
    top = F.array_max("p.top")
    scaled = F.transform("p", lambda x: F.struct(F.exp(x["top"] - F.col("top")).alias("scale"), x["mass"].alias("mass"), x["part"].alias("part")))
    mass = F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x["scale"] * x["mass"]).alias("mass")
    found = found.withColumn("top", top).withColumn("p", scaled)
    return found.select(*keys, "top", mass, merge(F.col("p")).alias("part"))


def _by_cell(parts: DataFrame, merge) -> DataFrame:
    """Merged inside each cell, where all rows already are, then over the cells of a query."""
    in_cell = _merged(parts, ["sentence", "row", "col", "q_pos"], merge)
    return _merged(in_cell, ["sentence", "q_pos"], merge)


def attention_output(
    tokens: DataFrame, sentence: str = "sentence", pos: str = "pos", vector: str = "vec", block: int = BLOCK
) -> DataFrame:
    """(sentence, pos, context): value vectors weighted and summed per query.

    Where a query meets a key block, the block shrinks to its top score, its sum
    of weights and one weighted vector. These are rescaled to the highest top as they
    are added up, in the cell and then over the cells.
    """
    local = _local(tokens, sentence, pos, vector, block)
    zeros = F.transform(F.element_at("keys.vec", 1), lambda _: F.lit(0.0))
    pairs = F.arrays_zip(F.col("e").alias("e"), F.col("keys.vec").alias("v"))
    summed = F.aggregate(pairs, zeros, lambda acc, p: F.zip_with(acc, p["v"], lambda a, x: a + p["e"] * x))

    def merge(p):
        none = F.transform(p[0]["part"], lambda _: F.lit(0.0))
        return F.aggregate(p, none, lambda acc, x: F.zip_with(acc, x["part"], lambda a, v: a + x["scale"] * v))

    merged = _by_cell(local.withColumn("part", summed), merge)
    return merged.select("sentence", F.col("q_pos").alias("pos"), F.transform("part", lambda x: x / F.col("mass")).alias("context"))


def attention_top(
    tokens: DataFrame, m: int, sentence: str = "sentence", pos: str = "pos", vector: str = "vec", block: int = BLOCK
) -> DataFrame:
    """(sentence, q_pos, rank, k_pos, score, weight): the ``m`` keys that each query attends to most, best first.

    Weights are those of the softmax over all keys of the sentence. Equal scores go by
    position. Every block hands on its ``m`` best and its sum of exponentials, cells merge
    them, so the output and what is shuffled after the join grow with the tokens and
    not with their pairs. A sentence of fewer tokens has fewer rows per query.
    """
    if m < 1:
        raise ValueError(f"m must be 1 or more, not {m}")

    def best(found):
        return F.slice(F.array_sort(found), 1, m)

    # structs sort by the first field: the negative score, then the position
    found = F.transform(F.arrays_zip(F.col("scores").alias("s"), F.col("keys.pos").alias("k")), lambda x: F.struct((-x["s"]).alias("down"), x["k"].alias("k_pos")))
    merged = _by_cell(_local(tokens, sentence, pos, vector, block).withColumn("part", best(found)), lambda p: best(F.flatten(p["part"])))
    ranked = merged.select("sentence", "q_pos", "top", "mass", F.posexplode("part").alias("rank", "k"))
    score = -F.col("k.down")
    return ranked.select("sentence", "q_pos", (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("k.k_pos").alias("k_pos"), score.alias("score"), (F.exp(score - F.col("top")) / F.col("mass")).alias("weight"))


def attention_append(context: DataFrame, extra: DataFrame) -> DataFrame:
    """Context vectors and the raw vectors of extra tokens (``sentence``, ``pos``, ``context``)."""
    return context.unionByName(extra.select("sentence", "pos", F.col("vec").cast("array<double>").alias("context")))
