"""CSV with line breaks in quotes, read by as many tasks as the files have ranges.

Spark's text source cuts files into byte ranges at line ends, but a line end may lie in
quotes. A first pass over the lines that hold a quote says for each range in which state
it would end if it began outside quotes, and if it began inside. These functions of two
states are put together over the ranges of a file in one window, so every range's true
first state is known. The second pass joins lines to records range by range. What a
range begins inside of, and what it leaves open, are parts of a record that lies across
ranges; these alone are brought together. A quote opens a field at its start only, is
doubled inside, and closes before a delimiter or a line end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Types tried for columns without a schema, in this order; text if none fits.
INFERRED = ("int", "bigint", "double", "date", "timestamp", "boolean")

# Whole fields from a field's start on, each with its delimiter.
_FIELDS = re.compile(r'(?:(?:"(?:[^"]|"")*+"[^,]*|[^",][^,]*|),)*+')
_CLOSED = re.compile(r'"(?:[^"]|"")*+"')
# What is left of a quoted field, with the delimiter or line end.
_REST = re.compile(r'(?:[^"]|"")*+"[^,]*(,|$)')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside quotes, by whether it begins inside."""
    line = line.removesuffix("\r")
    at = 0
    if inside:
        rest = _REST.match(line)
        if not rest:
            return True
        if not rest[1]:
            return False
        at = rest.end()
    at = _FIELDS.match(line, at).end()
    return line.startswith('"', at) and not _CLOSED.match(line, at)


def _lines(spark: SparkSession, path, position: bool) -> DataFrame:
    """``value`` of every line, its file as a hash (``file``, by name if asked for), and the first byte of its range."""
    found = spark.read.text(path, lineSep="\n")
    name = F.col("_metadata.file_path")
    more = [name.alias("name")] if position else []
    return found.select("value", F.xxhash64(name).alias("file"), F.col("_metadata.file_block_start").alias("start"), *more)


def _of_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The lines of a task range by range, as they come."""
    for batch in batches:
        file, start = (batch.column(c).to_numpy() for c in ("file", "start"))
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
        for first, last in pairwise([0, *cuts.tolist(), batch.num_rows]):
            if first < last:
                yield (int(file[first]), int(start[first])), batch.slice(first, last - first)


def range_states(lines: DataFrame) -> DataFrame:
    """``file``, ``start``, ``inside``: whether a range begins inside quotes, for all ranges of files that hold a quote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ends, quoted = None, [False, True], False

        def row():
            return pa.RecordBatch.from_pydict({"file": [now[0]], "start": [now[1]], "outside_to": [ends[0]], "inside_to": [ends[1]], "quoted": [quoted]})

        for key, rows in _of_ranges(batches):
            if key != now:
                if now:
                    yield row()
                now, ends, quoted = key, [False, True], False
            for line in rows.column("value").drop_null().to_pylist():
                ends, quoted = [ends_inside(line, x) for x in ends], True
        if now:
            yield row()

    slim = lines.select(F.when(F.contains("value", F.lit('"')), F.col("value")).alias("value"), "file", "start")
    told = slim.mapInArrow(run, "file bigint, start bigint, outside_to boolean, inside_to boolean, quoted boolean")
    order = Window.partitionBy("file").orderBy("start")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a range says the state after it, or turns it round, or leaves it: the last said one and the turns since count
    turns = F.sum((F.col("outside_to") & ~F.col("inside_to")).cast("int")).over(so_far) % 2 == 1
    counted = told.withColumn("turned", turns).withColumn("any", F.bool_or("quoted").over(Window.partitionBy("file")))
    said = F.when(F.col("outside_to") == F.col("inside_to"), F.col("outside_to") != F.col("turned"))
    known = counted.withColumn("said", F.coalesce(F.last(said, ignorenulls=True).over(so_far), F.lit(False)))
    after = F.lag(F.col("said") != F.col("turned"), 1, False).over(order)
    return known.withColumn("inside", after).where("any").select("file", "start", "inside")


def _records(lines: DataFrame, inside: dict[int, dict[int, bool]]) -> DataFrame:
    """``file``, ``start``, ``line``, ``record``, ``part`` of whole records and of parts of those across ranges.

    ``line`` counts lines of a range; ``part`` is 0 for a whole record, 1 for the end of one,
    2 for the middle, 3 for the begin. ``inside`` says which ranges begin inside quotes.
    """
    sent = lines.sparkSession.sparkContext.broadcast(inside)
    named = "name" in lines.columns
    fields = [("file", pa.int64()), ("start", pa.int64()), *([("name", pa.string())] if named else []), ("line", pa.int64()), ("record", pa.string()), ("part", pa.int32())]
    schema = pa.schema(fields)

    def begins_inside(key: tuple[int, int]) -> bool:
        ranges = sent.value.get(key[0])
        if ranges is None:
            return False
        if key[1] not in ranges:
            raise ValueError("the files or the size of their ranges changed after the first look at them")
        return ranges[key[1]]

    def batch_of(key, name, places, records, part):
        n = len(places)
        head = [pa.array(np.full(n, key[0])), pa.array(np.full(n, key[1])), *([pa.repeat(name, n)] if named else [])]
        return pa.RecordBatch.from_arrays([*head, pa.array(places, pa.int64()), pa.array(records, pa.string()), pa.array([part] * n, pa.int32())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, name, state, seen, held, held_at, cut = None, None, False, 0, [], 0, False

        def left():
            """What the range leaves open: the begin of a record, or the middle of one that it began inside of."""
            if held:
                yield batch_of(now, name, [held_at], ["\n".join(held)], 2 if cut else 3)

        for key, rows in _of_ranges(batches):
            values = rows.column("value")
            if key != now:
                yield from left()
                now, state, seen, held, held_at = key, begins_inside(key), 0, [], 0
                name, cut = rows.column("name")[0].as_py() if named else None, state
            single = pc.invert(pc.match_substring(values, '"')).to_numpy(zero_copy_only=False).copy()
            places, records, done = [], [], 0
            quoted = (~single).nonzero()[0].tolist()
            if quoted and key[0] not in sent.value:
                raise ValueError("the files changed after the first look at them")
            for i in [*quoted, len(values)]:
                if state:  # lines without a quote go on with the open record
                    single[done:i] = False
                    held += values.slice(done, i - done).to_pylist()
                done = i + 1
                if i == len(values):
                    break
                line = values[i].as_py()
                after = ends_inside(line, state)
                if state or after:
                    if not held:
                        held_at = seen + i
                    held.append(line)
                    if not after:
                        if cut:
                            yield batch_of(key, name, [held_at], ["\n".join(held)], 1)
                            cut = False
                        else:
                            places.append(held_at)
                            records.append("\n".join(held))
                        held = []
                else:
                    single[i] = True
                state = after
            at = single.nonzero()[0]
            if len(at):
                yield batch_of(key, name, at + seen, values.take(pa.array(at)), 0)
            if places:
                yield batch_of(key, name, places, records, 0)
            seen += len(values)
        yield from left()

    ddl = "file bigint, start bigint, name string, line bigint, record string, part int"
    return lines.mapInArrow(run, ddl if named else ddl.replace("name string, ", ""))


def records(spark: SparkSession, path, position: bool = False) -> DataFrame:
    """``file``, ``start``, ``line``, ``record``: every record as its text, and its place; ``name`` of its file with ``position``.

    ``start`` and ``line`` order the records of a file. Empty lines are no records. A file
    without a line end at its end, carriage returns before line ends, and an empty file
    are as usual; a quote that is never closed makes the rest of its file one record.
    The list of ranges of files with quotes is sent to the tasks; it has a number per
    range of ``spark.sql.files.maxPartitionBytes``. Both looks at the files must cut them
    alike: reading fails if that setting, or a file, changes between them.
    """
    lines = _lines(spark, path, position)
    inside: dict[int, dict[int, bool]] = {}
    for r in range_states(lines).toLocalIterator():
        inside.setdefault(r.file, {})[r.start] = r.inside
    found = _records(lines, inside)
    whole = found.where("part = 0").drop("part")
    if any(x for ranges in inside.values() for x in ranges.values()):
        # the same scan, so that files are cut alike; only parts of records are shuffled
        order = Window.partitionBy("file").orderBy("start", "line", "part")
        of = F.sum((F.col("part") == 3).cast("int")).over(order)
        more = [F.min("name").alias("name")] if position else []
        parts = F.sort_array(F.collect_list(F.struct("start", "line", "record"))).alias("parts")
        joined = found.where("part > 0").withColumn("of", of).groupBy("file", "of").agg(parts, *more)
        first = F.col("parts")[0]
        joined = joined.select("file", first["start"].alias("start"), *(["name"] if position else []), first["line"].alias("line"), F.array_join("parts.record", "\n").alias("record"))
        whole = whole.unionByName(joined)
    return whole.withColumn("record", F.regexp_replace("record", "\r$", "")).where("record <> ''")


def _fits(column: str, kind: str) -> Column:
    """How many values of a text column are none of a type."""
    return F.count_if(F.col(column).isNotNull() & F.expr(f"try_cast(`{column}` AS {kind})").isNull())


def infer(table: DataFrame) -> StructType:
    """The first of ``INFERRED`` that all values of a text column are, in one pass; text for a column without values."""
    names = table.columns
    checks = [_fits(c, kind).alias(f"{i}_{kind}") for i, c in enumerate(names) for kind in INFERRED]
    row = table.agg(*checks, *[F.count(f"`{c}`").alias(f"{i}_n") for i, c in enumerate(names)]).first()
    kinds = [next((k for k in INFERRED if row[f"{i}_n"] and not row[f"{i}_{k}"]), "string") for i in range(len(names))]
    return StructType.fromDDL(", ".join(f"`{c}` {k}" for c, k in zip(names, kinds, strict=True)))


def read(spark: SparkSession, path, schema: StructType | None, options: dict, position: str | None = None, typed: bool = True) -> DataFrame:
    """A table from CSV files with a header each; without a schema, columns are typed by their values, or are text if not ``typed``.

    ``position`` names a column that orders the rows as they stand in the files, by file
    name, then place.
    """
    found = records(spark, path, position is not None)
    options = {k: str(v) for k, v in options.items() if k != "header"}
    given = schema
    if schema is None:
        schema = _header(found, options)
        if not len(schema):
            return spark.createDataFrame([], schema)
    place = [F.struct(F.col("name").alias("file"), "start", "line").alias(position)] if position else []
    rows = found.where("start > 0 OR line > 0").select(*place, F.from_csv("record", _ddl(schema), options).alias("_row"))
    table = rows.select(*([position] if position else []), "_row.*")
    if given is not None or not typed:
        return table
    found = infer(table.drop(position) if position else table)
    cast = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in found]
    return table.select(*([position] if position else []), *cast)


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


def _header(found: DataFrame, options: dict) -> StructType:
    """Text columns by the names in the header of one of the files."""
    first = found.where("start = 0 AND line = 0").select(F.regexp_replace("record", "^\ufeff", "").alias("record")).limit(1).collect()
    if not first:
        return StructType([])
    width = first[0].record.count(",") + 1  # at least as many as there are names
    several = StructType([StructField(f"c{i}", StringType()) for i in range(width)])
    names = found.sparkSession.createDataFrame(first, "record string").select(F.from_csv("record", _ddl(several), options)).first()[0]
    return StructType([StructField(x, StringType()) for x in names if x is not None])
