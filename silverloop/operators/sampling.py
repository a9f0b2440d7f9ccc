"""Reproducible order, top-k, samples and splits.

Random order is the order of ``md5(seed:key)``. It depends on the data only,
not on partitions or retries. Exact cut points are found without a global sort:
rows are counted by the leading hex digits of the hash, the counts say which
bucket holds a cut, and only that bucket is ranked. The rows themselves are then
filtered in place against the cut hash, so no sampling operator shuffles text.

``key`` is one column or several and must be unique (``check_contract`` counts repeats). Equal keys hash alike and
fall on the same side of a cut, so a repeated key at a cut makes the part larger.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# 16 ** 4 = 65,536 buckets: the most rows that the count table has per class.
BUCKET_DIGITS = 4
# Rows that one bucket may hold; and the digits of a key's hash and a row's hash.
BUCKET_ROWS = 1_000_000
ORDER_DIGITS = 48


def _check(digits: int) -> None:
    """Counts by so many digits are broadcast."""
    if not 1 <= digits <= 4:
        raise ValueError(f"digits must be 1 to 4, not {digits}")


def seeded_key(seed: int, key: str | Sequence[str]) -> Column:
    """The hash that rows are ordered by."""
    names = [key] if isinstance(key, str) else list(key)
    if len(names) > 1:  # a null is not the same as nothing: it keeps its place among the parts
        parts = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in names]
    else:
        parts = [F.col(k).cast("string") for k in names]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def _bucket_counts(df: DataFrame, order: Column, cls: Column | None, digits: int) -> tuple[DataFrame, DataFrame]:
    """The narrow (cls, h, bucket) view of ``df`` and its rows per bucket."""
    keyed = df.select(
        (F.lit("all") if cls is None else cls.cast("string")).alias("cls"), order.alias("h")
    ).withColumn("bucket", F.substring("h", 1, digits))
    return keyed, keyed.groupBy("cls", "bucket").agg(F.count(F.lit(1)).alias("n"))


def hash_cuts(
    df: DataFrame,
    order: Column,
    targets: Callable[[list[Column]], dict[str, Column]],
    cls: Column | None = None,
    classes: Sequence = ("all",),
    digits: int = BUCKET_DIGITS,
) -> Column:
    """Scalar map from ``class/cut`` to the hash of the last row inside that cut.

    ``targets`` gets the row count of every class and returns, per ``class/cut``,
    which row of the class ends the cut. Cuts that take no row are absent. The
    count table has at most classes x 16 ** digits rows and the broadcast one at
    most one row per cut.
    """
    _check(digits)
    keyed, counts = _bucket_counts(df, order, cls, digits)
    names = [str(c) for c in classes]
    whole = Window.partitionBy()
    totals = {
        f"t{i}": F.coalesce(F.sum(F.when(F.col("cls") == c, F.col("n"))).over(whole), F.lit(0))
        for i, c in enumerate(names)
    }
    upto = Window.partitionBy("cls").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("cut"), F.lit(name.rsplit("/", 1)[0]).alias("cls"), want.cast("bigint").alias("want"))
            for name, want in targets([F.col(t) for t in totals]).items()
        ]
    )
    edges = (
        counts.withColumns({**totals, "upto": F.sum("n").over(upto)})
        .select("cls", "bucket", "n", "upto", F.explode(wanted).alias("w"))
        .where(
            (F.col("w.cls") == F.col("cls"))
            & (F.col("upto") - F.col("n") < F.col("w.want"))
            & (F.col("w.want") <= F.col("upto"))
        )
        .select("cls", "bucket", "w.cut", (F.col("w.want") - F.col("upto") + F.col("n")).alias("nth"))
    )
    # Copies of a key are counted before they are ranked, so they take one row here.
    reached = F.sum("copies").over(
        Window.partitionBy("cut", "bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    )
    hits = (
        keyed.join(F.broadcast(edges), ["cls", "bucket"])
        .groupBy("cut", "bucket", "nth", "h")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("reached", reached)
        .where((F.col("reached") >= F.col("nth")) & (F.col("reached") - F.col("copies") < F.col("nth")))
    )
    return hits.agg(F.map_from_entries(F.collect_list(F.struct("cut", "h")))).scalar()


def _class_name(label: Column, classes: Sequence) -> Column:
    """The class a label equals, as the text its cut goes by; null for any other label.

    Compared as values: 1, 1.0 and "1" are one class.
    """
    return F.coalesce(*[F.when(label == F.lit(c), F.lit(str(c))) for c in classes])


def _cut(cuts: Column, name: str | Column) -> Column:
    return F.try_element_at(cuts, F.lit(name) if isinstance(name, str) else name)


def _inside(order: Column, cuts: Column, name: str | Column) -> Column:
    """True up to and with the cut; false where the cut takes no row."""
    return F.coalesce(order <= _cut(cuts, name), F.lit(False))


def dedupe_keep_last(df: DataFrame, key: str | Sequence[str], position: str) -> DataFrame:
    """One row per key: the one with the greatest position, a null one being the least.

    An aggregate, not a window, so a key with many copies is reduced before the
    shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    # A null position is before any other; rows of equal position go by a hash of what they hold.
    order = F.struct(F.col(position).isNotNull(), F.col(position), F.xxhash64(*rest))
    latest = F.max_by(F.struct(*rest), order).alias("row")
    return df.groupBy(*keys).agg(latest).select(*[f"row.{c}" if c in rest else c for c in df.columns])


def top_uncertain(df: DataFrame, k: int = 100, u: str = "u", tie: str = "id") -> DataFrame:
    """The ``k`` rows with the highest ``u``; equal ``u`` goes by ``tie``, no number comes last."""
    return df.orderBy(F.nanvl(u, F.lit(None).cast("double")).desc_nulls_last(), F.col(tie)).limit(k)


def class_sample(
    df: DataFrame, label: str, n: int, key: str, seed: int = 42, classes: Sequence = (0, 1)
) -> DataFrame:
    """Exactly ``n`` rows of each class; running it fails where a class has fewer."""
    order, name = seeded_key(seed, key), _class_name(F.col(label), classes)
    known = df.where(F.col(label).isin(list(classes)))
    cuts = hash_cuts(known, order, lambda t: {f"{c}/n": F.lit(n) for c in classes}, name, classes)

    counted = known.agg(*[F.count_if(F.col(label) == c).alias(f"n{i}") for i, c in enumerate(classes)])
    enough = F.lit(True)
    for i, c in enumerate(classes):
        message = F.format_string(f"class {c} has %d rows, fewer than {n}", f"n{i}")
        enough = F.when(F.col(f"n{i}") < n, F.raise_error(message).cast("boolean")).otherwise(enough)
    inside = _inside(order, cuts, F.concat(name, F.lit("/n")))
    return known.where(counted.select(enough).scalar() & inside)


def cap_sample(df: DataFrame, n: int | None, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows by seeded order where there are more, else all rows."""
    if n is None:
        return df
    order = seeded_key(seed, key)
    cuts = hash_cuts(df, order, lambda t: {"all/n": F.least(t[0], F.lit(n))})
    return df.where(_inside(order, cuts, "all/n"))


def split_60_20_20(
    df: DataFrame,
    key: str,
    seed: int = 42,
    names: Sequence[str] = ("train_silver", "eval_silver", "pool_unlabeled"),
    train_fraction: float = 0.6,
    eval_fraction: float = 0.5,
    out: str = "split",
) -> DataFrame:
    """Add the split name: 60 % train, half of the rest eval, what is left pool."""

    def targets(totals: list[Column]) -> dict[str, Column]:
        train = F.bround(totals[0] * F.lit(train_fraction)).cast("bigint")
        evaluation = F.bround((totals[0] - train) * F.lit(eval_fraction)).cast("bigint")
        return {"all/train": train, "all/eval": train + evaluation}

    order = seeded_key(seed, key)
    cuts = hash_cuts(df, order, targets)
    name = (
        F.when(_inside(order, cuts, "all/train"), names[0])
        .when(_inside(order, cuts, "all/eval"), names[1])
        .otherwise(names[2])
    )
    return df.withColumn(out, name)


def stratified_split(
    df: DataFrame,
    label: str,
    key: str,
    test_fraction: float = 0.15,
    seed: int = 42,
    classes: Sequence = (0, 1),
    out: str = "part",
) -> DataFrame:
    """Add ``train``/``test`` with the class balance kept in both.

    ceil(fraction x n) rows are test rows. Each class gets the whole part of its
    share; the rows left over go to the largest remainders, then to the class
    named first. Rows of no named class, null labels among them, have a null part.
    """

    def targets(totals: list[Column]) -> dict[str, Column]:
        n_all = sum(totals[1:], totals[0])
        n_test = F.ceil(n_all * F.lit(test_fraction)).cast("bigint")
        # Decimal, so that counts of 10 ** 12 rows multiply without overflow.
        shares = [n_test.cast("decimal(18,0)") * t.cast("decimal(18,0)") for t in totals]
        rest = [s % n_all for s in shares]
        whole = [F.round((s - r) / n_all).cast("bigint") for s, r in zip(shares, rest)]
        left_over = n_test - sum(whole[1:], whole[0])
        wants = {}
        for i, c in enumerate(classes):
            ahead = [
                ((r > rest[i]) | ((r == rest[i]) & F.lit(j < i))).cast("int") for j, r in enumerate(rest) if j != i
            ]
            place = sum(ahead, F.lit(0))
            wants[f"{c}/test"] = whole[i] + (place < left_over).cast("int")
        return wants

    order, name = seeded_key(seed, key), _class_name(F.col(label), classes)
    cuts = hash_cuts(df.where(name.isNotNull()), order, targets, name, classes)
    is_test = _inside(order, cuts, F.concat(name, F.lit("/test")))
    return df.withColumn(out, F.when(name.isNull(), F.lit(None)).when(is_test, "test").otherwise("train"))


def _refined(marked: DataFrame, digits: int, bucket_rows: int) -> tuple[Column, list[str]]:
    """The bucket of every row, as a prefix of ``_o``, and the buckets of equal rows that are still too large.

    A bucket of more than ``bucket_rows`` rows is split by further digits: first those of
    the key's hash, then those of the row's. There are at most rows / ``bucket_rows`` such
    buckets, so their names go into the plan; each is split in 65,536 or so.
    """
    depths = [digits, 2 * BUCKET_DIGITS, *range(32 + BUCKET_DIGITS, ORDER_DIGITS, BUCKET_DIGITS), ORDER_DIGITS]
    bucket, hot_at = F.substring("_o", 1, digits), []
    for depth, deeper in zip(depths, [*depths[1:], None], strict=True):
        counts = marked.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        hot = [r.bucket for r in counts.where(F.col("n") > bucket_rows).collect()]
        if not hot or deeper is None:
            break
        hot_at.append((depth, deeper, hot))
        bucket = F.substring("_o", 1, digits)
        for shallow, deep, names in hot_at:  # the deepest split that a row is in holds
            bucket = F.when(F.substring("_o", 1, shallow).isin(names), F.substring("_o", 1, deep)).otherwise(bucket)
    return bucket, hot


def _copies(rows: DataFrame, columns: list[str], weight: Column, start: Column, out: str, chunk: int) -> DataFrame:
    """Equal rows numbered one after the other: counted before any shuffle, then made again in parts of ``chunk``."""
    counted = rows.groupBy(*columns, "_bucket", "_weight", "_start").agg(F.count(F.lit(1)).alias("_n"))
    parts = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(chunk).cast("bigint"))))
    spread = parts.repartition("_bucket", "_from")
    nth = F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + chunk, F.col("_n")) - 1)).alias("_i")
    made = spread.select("*", nth)
    return made.withColumn(out, start + F.col("_i") * weight).select(*columns, out)


def running_total(
    df: DataFrame, order: Column, weight: Column, out: str, digits: int = BUCKET_DIGITS, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Add the sum of ``weight`` over all rows before this one in hash order; equal hashes go by a hash of the row.

    Exact over the whole table without one global window: bucket sums give every
    bucket its start, and rows are summed inside their bucket. A bucket that one key fills
    is split by its rows' hashes, so a key on a third of the rows is many tasks; equal
    rows in large numbers are counted and made again. The starts, one row per bucket, are
    at most 16 ** ``digits`` (4 at most) and the split ones, and are broadcast.
    """
    _check(digits)
    row = F.lpad(F.lower(F.hex(F.xxhash64(*df.columns))), 16, "0")
    marked = df.withColumns({"_o": F.concat(order, row), "_weight": weight.cast("bigint")})
    bucket, equal = _refined(marked.select("_o"), digits, bucket_rows)
    marked = marked.withColumn("_bucket", bucket)
    sums = marked.groupBy("_bucket").agg(F.sum("_weight").alias("_sum"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("_bucket").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    position = F.col("_start") + F.coalesce(F.sum("_weight").over(inner), F.lit(0))
    begun = marked.join(F.broadcast(starts), "_bucket")
    placed = begun.where(~F.col("_bucket").isin(equal)) if equal else begun
    placed = placed.withColumn(out, position).drop("_o", "_weight", "_bucket", "_start")
    if equal:
        copies = _copies(begun.where(F.col("_bucket").isin(equal)), df.columns, F.col("_weight"), F.col("_start"), out, bucket_rows)
        placed = placed.unionByName(copies)
    return placed


def seeded_shuffle(
    df: DataFrame, key: str, seed: int = 42, out: str = "row_index", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Number all rows 0..n-1 in seeded random order."""
    return running_total(df, seeded_key(seed, key), F.lit(1), out, bucket_rows=bucket_rows)
