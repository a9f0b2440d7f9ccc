"""Benchmark decontamination by winnowing.

The words of a text make k-grams; of every w consecutive k-gram hashes the smallest
(the last of equals) is kept. A span of ``k + w - 1`` words that document and item
share makes the same w hashes on both sides, so both keep the same one of them. Kept
hashes are joined, and every joined pair is extended word by word to both sides: runs
of at least that many equal words are hits. A kept hash carries the words a span
around it can reach, so the extension compares words and not hashes, and no text is
joined. Items shorter than a span are one span: they are found by the hash of all
their words.

The benchmark's hashes are also sent to the tasks that read documents, where they
thin out the document side before the join, if there are at most ``MAX_SENT``
of them (8 bytes each); beyond that the join alone does the work, with the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverloop.llm.common import chunks, stage, texts_of

SPAN = 10
GRAM = 5
MAX_SENT = 4_000_000

_UPPER = bytes(range(65, 91))
_GAPS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes.maketrans(_UPPER + _GAPS, _UPPER.lower() + b" " * len(_GAPS))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD
    return h ^ (h >> np.uint64(29))


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive word hashes."""
    n = len(words) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        out = _mixed(out * _ODD + words[i : i + n])
    return out


def winnowed(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` consecutive hashes the place of the smallest, the last of equals."""
    n = len(hashes) - width + 1
    at, best = np.arange(n), hashes[:n].copy()
    for i in range(1, width):
        take = hashes[i : i + n] <= best
        best = np.where(take, hashes[i : i + n], best)
        at = np.where(take, np.arange(i, i + n), at)
    return at


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    base = 0xD6E8FEB86659FD93
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (base, pow(base, -1, 1 << 64)))


def split_words(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one folded byte string, the bounds of its words, and how many each text has."""
    parts = [t.encode().translate(_FOLD) for t in texts]
    line = b" ".join(parts) + b" "
    gap = np.frombuffer(line, np.uint8) == 32
    starts = np.flatnonzero(~gap & np.append(True, gap[:-1]))
    ends = np.flatnonzero(gap & np.append(False, ~gap[:-1]))
    cuts = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    return line, starts, ends, np.diff(np.searchsorted(starts, cuts), prepend=0)


def _word_hashes(line: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(line))
    total = np.append(np.uint64(0), np.cumsum((np.frombuffer(line, np.uint8).astype(np.uint64) + np.uint64(1)) * power[:-1]))
    return _mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _prints(texts: list[str], gram: int, span: int, lengths: list[int], wanted: np.ndarray | None, items: bool):
    """Word counts of the texts and their fingerprints (text, kind, hash, first word, words before, words around)."""
    line, starts, stops, counts = split_words(texts)
    hashed = _word_hashes(line, starts, stops)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(texts)), counts)
    found = []

    def keep(kind: int, at: np.ndarray, h: np.ndarray) -> None:
        if wanted is not None and len(at):
            place = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
            hit = wanted[place] == h if len(wanted) else np.zeros(len(h), bool)
            at, h = at[hit], h[hit]
        if len(at):
            found.append((np.full(len(at), kind), at, h))

    for n in lengths:
        h = _mixed(_grams(hashed, n) + np.uint64(n))
        at = np.flatnonzero(owner[: len(h)] == owner[n - 1 :]) if len(h) else np.empty(0, np.int64)
        at = at[counts[owner[at]] == n] if items else at
        keep(n, at, h[at])
    h = _grams(hashed, gram)
    if len(hashed) >= span:
        first = np.flatnonzero(owner[: len(hashed) - span + 1] == owner[span - 1 :])  # spans inside a text
        at = np.unique(winnowed(h, span - gram + 1)[first])
        keep(0, at, h[at])
    if not found:
        return counts, None
    kind, at, h = (np.concatenate(x) for x in zip(*found, strict=True))
    who = owner[at]
    start = at - (ends - counts)[who]
    before = np.where(kind > 0, 0, np.minimum(start, span - gram))
    after = np.where(kind > 0, kind, np.minimum(counts[who] - start, span))
    around = [b" ".join(line[a:b].split()).decode() for a, b in zip(starts[at - before].tolist(), stops[at + after - 1].tolist(), strict=True)]
    return counts, (who, kind, h, start, before, around)


def _run(batches: Iterator[pa.RecordBatch], gram: int, span: int, lengths: list[int], sent, items: bool) -> Iterator[pa.RecordBatch]:
    wanted = sent.value if sent else None
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("_id"))
        rows = batch.column(batch.schema.get_field_index("_row"))
        for first, last, texts in chunks(batch, 1_000_000):
            counts, got = _prints(texts, gram, span, lengths, wanted, items)
            if not items:
                none = [pa.nulls(last - first, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())]
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), rows.slice(first, last - first), pa.array(counts), *none], _NAMES)
            if got:
                who, kind, h, start, before, around = got
                at = pa.array(first + who)
                more = [pa.array(counts[who]), pa.array(kind.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(start), pa.array(before.astype(np.int32)), pa.array(around, pa.string())]
                yield pa.RecordBatch.from_arrays([ids.take(at), rows.take(at), *more], _NAMES)


_NAMES = ["_id", "_row", "n_words", "kind", "hash", "start", "before", "around"]


def _fingerprints(rows: DataFrame, **how) -> DataFrame:
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_run, **how), f"_id {kind}, _row bigint, n_words bigint, kind int, hash bigint, start bigint, before int, around string")


def _extended(pairs: DataFrame, gram: int, span: int) -> DataFrame:
    """``first``, ``last`` (exclusive) of the equal run around each joined pair, where it is long enough."""
    a, b = F.split("around", " "), F.split("item_around", " ")

    def run(step: str):
        if step == "left":
            n = F.least("before", "item_before")
            same = [F.when(F.lit(i) < n, F.element_at(a, F.col("before") - i) == F.element_at(b, F.col("item_before") - i)) for i in range(span - gram)]
        else:
            n = F.least(F.size(a) - F.col("before"), F.size(b) - F.col("item_before"))
            same = [F.when(F.lit(i) < n, F.element_at(a, F.col("before") + i + 1) == F.element_at(b, F.col("item_before") + i + 1)) for i in range(span)]
        # equal words in a row, counted up to the first that differs or isn't there
        flags = F.array(*[F.coalesce(x, F.lit(False)) for x in same], F.lit(False))
        return (F.array_position(flags, False) - 1).cast("bigint")

    whole = pairs.where("kind > 0 AND around = item_around").select("_row", "item_id", F.col("start").alias("first"), (F.col("start") + F.col("kind")).alias("last"))
    grown = pairs.where("kind = 0").select("*", run("left").alias("l"), run("right").alias("r")).where((F.col("r") >= gram) & (F.col("l") + F.col("r") >= span))
    grown = grown.select("_row", "item_id", (F.col("start") - F.col("l")).alias("first"), (F.col("start") + F.col("r")).alias("last"))
    return whole.unionByName(grown)


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM, max_sent: int = MAX_SENT
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``n_words``, ``n_hit``, ``n_items``, ``items`` (ids as sorted strings), ``spans``.

    ``spans`` are the hit word ranges (first, end) in order, without overlap. Null and
    wordless texts have no words and no hits; items without words match nothing;
    items with a null id match under the id ``""``; repeated rows and items count
    once per row and id. Input must be a stored table: its rows are told apart by
    their position in the scan.
    """
    if not 0 < gram <= span:
        raise ValueError("a k-gram must fit into a span")
    spark = docs.sparkSession
    rows = texts_of(docs, id_col, text_col, F.monotonically_increasing_id().alias("_row"))
    bench = texts_of(items, item_col, item_text, F.lit(0).cast("bigint").alias("_row"))
    side = _fingerprints(bench, gram=gram, span=span, lengths=list(range(1, span)), sent=None, items=True)
    side = side.select("kind", "hash", F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("item_id"), F.col("before").alias("item_before"), F.col("around").alias("item_around")).distinct()
    hashes = side.select("hash").distinct().limit(max_sent + 1).toArrow().column(0).to_numpy()
    lengths = [r.kind for r in side.where("kind > 0").select("kind").distinct().collect()]
    sent = spark.sparkContext.broadcast(np.sort(hashes.view(np.uint64))) if len(hashes) <= max_sent else None
    # written once: the word counts and the hashes to join are read on two ways
    prints = stage(_fingerprints(rows, gram=gram, span=span, lengths=sorted(lengths), sent=sent, items=False), "winnow")
    joined = prints.where("hash IS NOT NULL").join(side, ["kind", "hash"])
    hits = _extended(joined, gram, span).groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("runs"), F.array_sort(F.collect_set("item_id")).alias("items"))
    base = prints.where("hash IS NULL").select("_id", "_row", "n_words")
    merged = F.aggregate(
        "runs",
        F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["last"] >= x["first"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], x["last"]).alias("last")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    out = base.join(hits, "_row", "left").select("_id", "n_words", F.coalesce(merged, F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x["last"] - x["first"])
    return out.select(F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", "spans")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns, whatever their ids.

    Rows are known by a hash of all they hold and one of their text: equal rows have
    equal fates.
    """
    keyed = docs.select(F.xxhash64(*docs.columns).alias("_key"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("_sum"), F.struct("*").alias("_row_of"))
    found = contamination(keyed.select(F.struct("_key", "_sum").alias("_pair"), F.col("_row_of")[text_col].alias("_body")), items, "_pair", "_body", **how)
    hit = found.where("n_hit > 0").select("_pair._key", "_pair._sum").distinct()
    return keyed.join(hit, ["_key", "_sum"], "left_anti").select("_row_of.*")
