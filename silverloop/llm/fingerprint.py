"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame operations only.

A text's paragraphs (its lines, in pieces of at most ``PIECE`` code points) have 40-bit
digests. A sketch has three tables of cells; every digest is added to one cell of each
table: to its count, its sum of digests and its sum of check values. Sketches of two
versions are subtracted cell by cell, so what they share is gone. A cell whose sums are
those of one digest, some number of times, gives it up; it is taken out of its other
cells, which may then give up theirs. Tables are peeled in turn, as in one table a digest
has one cell. What stays unpeeled is tried again with a sketch large enough for both
texts, then with larger ones and other hash functions, until all is recovered.

Texts travel once, to meet the next text in order; after that only digests do, once
per attempt, and all rounds of peeling run where the digests are.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverloop.llm.common import stage, texts_of

PIECE = 160
UNITS = f"[^\\n]{{1,{PIECE}}}"
TABLES = 3
CELLS = 8  # of each table of a fingerprint
ROUNDS = 9
PRIME = 2147483647
BUCKETS_PER_PARTITION = 2


def constants(table: int, level: int) -> tuple[int, int, int]:
    """Factors and shift of a hash function; ``table`` -1 is the check value, the same at all levels."""
    draw = random.Random(1000 * (level if table >= 0 else 0) + table + 1)
    return draw.randrange(1, PRIME), draw.randrange(1, PRIME), draw.randrange(PRIME)


def _hash(d: Column, table: int, level: int) -> Column:
    a, c, b = constants(table, level)
    return ((d % PRIME) * a + F.shiftright(d, 31) * c + b) % PRIME


def _cell(d: Column, table: int, level: int, cells: Column) -> Column:
    return _hash(d, table, level) % cells + cells * table


def digests(text: Column) -> Column:
    """Digests of a text's paragraphs in order, as an array."""
    return F.transform(F.regexp_extract_all(text, F.lit(UNITS), F.lit(0)), lambda u: F.conv(F.substring(F.md5(u), 1, 10), 16, 10).cast("bigint"))


def _sketched(parts: DataFrame, keys: list[str], level: int, cells: Column) -> DataFrame:
    """Non-zero cells per ``keys``: ``parts`` has an array ``d`` and its sign."""
    one = parts.select(*keys, "sign", cells.alias("_m"), F.explode("d").alias("_d"))
    added = F.array(*[_cell(F.col("_d"), t, level, F.col("_m")) for t in range(TABLES)])
    spread = one.select(*keys, "_m", "sign", (F.col("_d") * F.col("sign")).alias("_k"), (_hash(F.col("_d"), -1, level) * F.col("sign")).alias("_g"), F.explode(added).alias("cell"))
    summed = spread.groupBy(*keys, "_m", "cell").agg(F.sum("sign").alias("n"), F.sum("_k").alias("key"), F.sum("_g").alias("check"))
    return summed.where("n <> 0 OR key <> 0 OR check <> 0")


def _peeled(cells: DataFrame, keys: list[str], level: int, rounds: int) -> DataFrame:
    """Cells after peeling; a recovered digest d is a row with cell -1 - d and the number of times it is too many."""
    for r in range(rounds):
        t = r % TABLES
        cells = cells.withColumn("_d", F.expr("key div (CASE WHEN n = 0 THEN 1 ELSE n END)"))
        d = F.col("_d")
        in_table = (F.col("cell") >= F.col("_m") * t) & (F.col("cell") < F.col("_m") * (t + 1))
        pure = in_table & (F.col("n") != 0) & (d >= 0) & (d * F.col("n") == F.col("key")) & (_hash(d, -1, level) * F.col("n") == F.col("check")) & (_cell(d, t, level, F.col("_m")) == F.col("cell"))
        same = F.struct(F.col("cell").alias("cell"), F.col("n").alias("n"), F.col("key").alias("key"), F.col("check").alias("check"))
        out = [F.struct(_cell(d, o, level, F.col("_m")).alias("cell"), (-F.col("n")).alias("n"), (-F.col("key")).alias("key"), (-F.col("check")).alias("check")) for o in range(TABLES) if o != t]
        found = F.struct((-1 - d).alias("cell"), F.col("n").alias("n"), F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("check"))
        moved = cells.select(*keys, "_m", F.explode(F.when(pure, F.array(found, *out)).otherwise(F.array(same))).alias("_x"))
        moved = moved.select(*keys, "_m", "_x.*")
        cells = moved.groupBy(*keys, "_m", "cell").agg(F.sum("n").alias("n"), F.sum("key").alias("key"), F.sum("check").alias("check")).where("n <> 0 OR key <> 0 OR check <> 0")
    return cells


def _pairs(table: DataFrame) -> DataFrame:
    """Both sides of each pair to compare, as arrays with a sign, next to the units of both."""
    sides = F.array(
        *[
            F.struct(F.lit(p).alias("pair"), F.lit(s).cast("bigint").alias("sign"), F.col(c).alias("d"), (F.size("d0") + F.size(o)).cast("bigint").alias("units"))
            for p, o in ((0, "d1"), (1, "d2"))
            for s, c in ((1, "d0"), (-1, o))
        ]
    )
    return table.select("_row", F.explode(sides).alias("_s")).select("_row", "_s.*")


def differences(table: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``_row``, ``pair``, ``differing``: paragraphs that only one side of each pair has, by multiplicity.

    ``table`` is stored and has ``_row`` and arrays ``d0``, ``d1``, ``d2``; pair 0 is d0
    against d1, pair 1 d0 against d2.
    """
    keys = ["_row", "pair"]
    todo, done, level = _pairs(table.repartition("_row")), None, 0
    while True:
        cells = F.lit(CELLS).cast("bigint") if level == 0 else F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("units"), F.lit(CELLS)))) + 2 * (level - 1)).cast("bigint")
        left = _peeled(_sketched(todo, keys, level, cells), keys, level, rounds)
        counted = left.groupBy(*keys).agg(F.sum(F.when(F.col("cell") < 0, F.abs("n")).otherwise(0)).alias("differing"), F.max(F.col("cell") >= 0).alias("failed"))
        counted = stage(counted, "peeled")
        solved = counted.where("NOT failed").select(*keys, "differing")
        done = solved if done is None else done.unionByName(solved)
        failed = counted.where("failed").select(*keys)
        if failed.isEmpty():
            return done
        level += 1
        again = table.join(failed.select("_row").distinct(), "_row", "left_semi").repartition("_row")
        todo = _pairs(again).join(failed, keys, "left_semi")


def _with_next(rows: DataFrame, buckets: int) -> DataFrame:
    """Every row with text and digests of the row after it by id; after the last comes the first.

    Rows are dealt to buckets by range of id; the first row of each bucket is also the
    last of the bucket before.
    """
    steps = 1
    while steps * 2 <= buckets:
        steps *= 2
    points = rows.agg(F.percentile_approx("_id", [i / buckets for i in range(1, buckets)] or [0.5], 10_000).alias("p")).first()["p"] or []
    points = sorted(set(points)) + [2**63 - 1] * (2 * steps)
    searched = F.split(F.lit(",".join(map(str, points))), ",").cast("array<bigint>")
    sizes = []
    while steps:
        sizes.append(steps)
        steps //= 2
    place = F.aggregate(
        F.array(*[F.lit(s) for s in sizes]), F.lit(0), lambda acc, s: F.when((F.element_at(searched, acc + s) <= F.col("_id")) & (F.element_at(searched, acc + s) < 2**63 - 1), acc + s).otherwise(acc)
    )
    dealt = rows.withColumn("_b", F.when(F.col("_id").isNull(), -1).otherwise(place))
    heads = sorted((r._b, r.low) for r in dealt.groupBy("_b").agg(F.min("_id").alias("low")).collect())
    if not heads:
        none = F.array().cast("array<bigint>")
        return dealt.withColumns({"_d": none, "_next": F.lit(""), "_next_d": none})
    before = rows.sparkSession.createDataFrame([(heads[i - 1][0], b, low) for i, (b, low) in enumerate(heads)], "_to int, _hb int, _low bigint")
    # as many rows as buckets, or more where an id repeats
    ghosts = dealt.join(F.broadcast(before), (F.col("_b") == F.col("_hb")) & F.col("_id").eqNullSafe(F.col("_low")))
    ghosts = ghosts.select("_id", "_text", F.col("_to").alias("_b"), F.lit(True).alias("_ghost"))
    both = dealt.select("_id", "_text", "_b", F.lit(False).alias("_ghost")).unionByName(ghosts)
    both = both.withColumn("_d", digests(F.col("_text")))
    order = Window.partitionBy("_b").orderBy("_ghost", F.col("_id").asc_nulls_first(), "_text")
    both = both.withColumns({"_next": F.lead("_text").over(order), "_next_d": F.lead("_d").over(order)})
    return both.where("NOT _ghost")


def _text_of(cells: Column, units: Column) -> Column:
    listed = F.transform(F.array_sort(cells), lambda c: F.concat_ws(".", c["cell"].cast("string"), c["n"].cast("string"), c["key"].cast("string"), c["check"].cast("string")))
    return F.concat_ws(";", units.cast("string"), F.array_join(listed, ","))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Per row ``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The edited text has the first quarter (rounded down) of the next text, by
    ascending integer id, in place of its own last quarter. A fingerprint is written
    as number of paragraphs, then non-zero cells as ``cell.count.sum.check``. Likeness
    is twice what two texts share of paragraphs, over the number both have; two texts
    without paragraphs have likeness 1. Null texts are empty, a null id comes first,
    repeated ids are in order of text; a table of one row is next to itself; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    buckets = buckets or BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _with_next(texts_of(docs, id_col, text_col).withColumn("_id", F.col("_id").cast("bigint")), buckets)
    n = F.length("_text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - quarter), F.substring("_next", F.lit(1), quarter))
    table = rows.select("_id", n.cast("bigint").alias("n_chars"), edited.alias("_edited"), F.col("_d").alias("d0"), F.col("_next_d").alias("d2"))
    table = table.select(F.monotonically_increasing_id().alias("_row"), "_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "d0", digests(F.col("_edited")).alias("d1"), "d2")
    table = stage(table, "digests")
    near = differences(table)

    sides = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(1).cast("bigint").alias("sign"), F.col(c).alias("d")) for v, c in ((0, "d0"), (1, "d1"))])
    parts = table.select("_row", "d0", "d1").repartition("_row").select("_row", F.explode(sides).alias("_s")).select("_row", "_s.*")
    cells = _sketched(parts, ["_row", "v"], 0, F.lit(CELLS).cast("bigint"))
    cells = cells.groupBy("_row").agg(F.collect_list(F.struct("v", "cell", "n", "key", "check")).alias("cells"))
    diff = near.groupBy("_row").agg(*[F.max(F.when(F.col("pair") == p, F.col("differing"))).alias(f"x{p}") for p in (0, 1)])
    base = table.select("_row", "_id", "n_chars", "edited_sha256", *[F.size(f"d{i}").cast("bigint").alias(f"u{i}") for i in range(3)])

    def likeness(i: int) -> Column:
        both = F.col("u0") + F.col(f"u{i}")
        return F.when(both == 0, 1.0).otherwise((both - F.coalesce(f"x{i - 1}", F.lit(0))) / both)

    def written(v: int) -> Column:
        own = F.filter(F.coalesce("cells", F.expr("cast(array() as array<struct<v:int,cell:bigint,n:bigint,key:bigint,check:bigint>>)")), lambda c: c["v"] == v)
        return _text_of(own, F.col(f"u{v}"))

    out = base.join(cells, "_row", "left").join(diff, "_row", "left")
    return out.select(
        F.col("_id").alias(id_col), "n_chars", "edited_sha256", written(0).alias("fingerprint"), written(1).alias("edited_fingerprint"), likeness(1).alias("near_edited"), likeness(2).alias("near_next")
    )
