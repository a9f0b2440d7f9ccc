"""Substring dedup by recompression.

A text is a row of words. First maximal runs of one word get one symbol, then, round
by round, neighbouring pairs do: a hash bit parts all symbols into left and right
ones, and a left symbol takes in the right symbol after it. A name is a hash of what it
stands for, so every task gives equal parts equal names without a dictionary. Each
symbol knows which words its existence depends on; in two copies of a passage all
symbols that depend on the passage alone are the same.

Round one in Spark counts the symbols of the last level, whose dependence fits into a
window, over the corpus. A window that holds such a symbol of which there is only one
can't be anywhere else. The symbols seen twice or more go into a bit filter of
fixed size, which is broadcast; a filter that fills up lets more windows through and
never fewer, so results don't depend on it.

Round two takes the windows left, puts each under its longest symbol, brings equal
symbols together and compares the windows there by their own hash. Runs of windows
that a task has met before are known as copies at once and are sent twice at most, so
a passage in a third of all documents makes two rows per task and not one per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from silverloop.llm.common import chunks, ragged, runs, texts_of, whole_groups

WINDOW = 35
ROUNDS = 6
FILTER_BITS = 27
# Run keys a task remembers; beyond it forgets and sends more rows.
REMEMBERED = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_FAR = np.int64(1) << 40


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the number of words per text."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = t.encode().split()
        counts[i] = len(words)
        hashes += map(digest, words)
    return np.array(hashes, np.uint64), counts


def recompress(words: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, ...]:
    """Last level of all texts: names, first and end word, first and end word each depends on."""
    owner = np.repeat(np.arange(len(counts)), counts)
    if not len(words):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none, none
    # runs of one word; all depend on the word before and after, by which runs end
    cut = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])))
    length = np.diff(np.append(cut, len(words)))
    names = np.where(length > 1, _mix(words[cut] * _ODD + length.astype(np.uint64)), words[cut])
    first, end, owner = cut, cut + length, owner[cut]
    edge = np.append(True, owner[1:] != owner[:-1])
    low = np.where(edge, -_FAR, first - 1)
    high = np.where(np.append(edge[1:], True), _FAR, end + 1)
    for level in range(rounds):
        is_left = (_mix(names + _ODD // np.uint64(level + 3)) >> np.uint64(63)).astype(bool)
        same = np.append(owner[1:] == owner[:-1], False)  # has a next symbol
        head = is_left & same & np.append(~is_left[1:], False)
        tail = np.append(False, head[:-1])
        lone = ~head & ~tail
        # a left symbol alone depends on the next one, a right symbol alone on the one before
        nxt, prev = np.minimum(np.arange(len(names)) + 1, len(names) - 1), np.maximum(np.arange(len(names)) - 1, 0)
        has_prev = np.append(False, same[:-1])
        other = np.where(is_left, nxt, prev)
        has = np.where(is_left, same, has_prev)
        other = np.where(head, nxt, other)
        joins = head | (lone & has)
        new_low = np.where(joins, np.minimum(low, low[other]), low)
        new_high = np.where(joins, np.maximum(high, high[other]), high)
        new_low[lone & ~has & ~is_left] = -_FAR
        new_high[lone & ~has & is_left] = _FAR
        new_names = np.where(head, _mix(names * _ODD + _mix(names[nxt])), names)
        new_end = np.where(head, end[nxt], end)
        keep = ~tail
        names, first, end, low, high, owner = new_names[keep], first[keep], new_end[keep], new_low[keep], new_high[keep], owner[keep]
    return names, first, end, low, high


def _anchors(words: np.ndarray, counts: np.ndarray, window: int, rounds: int):
    names, first, end, low, high = recompress(words, counts, rounds)
    fits = high - low <= window
    return names[fits], first[fits], end[fits], low[fits], high[fits]


def _bits_of(names: np.ndarray, bits: int) -> np.ndarray:
    a, b = names * _ODD, _mix(names) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.stack([a >> np.uint64(64 - bits), b >> np.uint64(64 - bits)]).astype(np.int64)


def _shared_filter(rows: DataFrame, window: int, rounds: int, bits: int) -> np.ndarray:
    """Bit filter of the symbols that the corpus has twice or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in chunks(batch):
                names = _anchors(*_words(texts), window, rounds)[0]
                names, n = np.unique(names, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.minimum(n, 2))], ["name", "n"])

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bits_of(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits).ravel()
            cells, place = np.unique(at >> 6, return_inverse=True)
            values = np.zeros(len(cells), np.int64)
            np.bitwise_or.at(values, place, np.int64(1) << (at & 63))
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(values)], ["cell", "bits"])

    counted = rows.select("_text").mapInArrow(count, "name bigint, n bigint").groupBy("name").agg(F.sum("n").alias("n"))
    cells = counted.where("n > 1").select("name").mapInArrow(set_bits, "cell bigint, bits bigint").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    return out


def _window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """Hash of every ``window`` consecutive words, from hashes of halves of it."""
    part, done, out = words.copy(), 1, None
    span, covered = window, 0
    while span:
        if span & 1:
            moved = part[covered:]
            out = moved if out is None else _mix(out[: len(moved)] * _ODD + moved)
            covered += done
        span >>= 1
        if span:
            part = _mix(part[:-done] * _ODD + part[done:] + np.uint64(done)) if len(part) > done else part[:0]
            done *= 2
    return out


def _candidates(texts: list[str], shared: np.ndarray, window: int, rounds: int, bits: int):
    """Runs of windows that may be elsewhere: name, text, first word, number, place of the first of their hashes,
    hashes of all windows, and whether those of a run are equal."""
    words, counts = _words(texts)
    n = len(words) - window + 1
    if n <= 0:
        return None
    begins = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    alive = owner[:n] == owner[window - 1 :]
    names, first, end, low, high = _anchors(words, counts, window, rounds)
    at = _bits_of(names, bits)
    known = ((shared[at >> 6] >> (at & 63)) & 1).all(axis=0)
    start, stop = np.maximum(high - window, 0), np.minimum(low, n - 1) + 1  # windows that hold what it depends on
    some = start < stop
    once = some & ~known
    change = np.bincount(start[once], minlength=n + 1) - np.bincount(stop[once], minlength=n + 1)
    alive &= np.cumsum(change)[:n] == 0
    # the longest symbol in each window: painted last
    best = np.full(n, -1)
    use = np.flatnonzero(some & known)
    use = use[np.lexsort((-first[use], names[use], end[use] - first[use]))]
    reach = stop[use] - start[use]
    best[ragged(start[use], reach)] = np.repeat(use, reach)
    here = np.flatnonzero(alive)
    if not len(here):
        return None
    hashes = _window_hashes(words, window)[here]
    top = best[here]
    # a window without a symbol goes under its own hash; such windows in a row are equal inside a run of one word
    name = np.where(top < 0, hashes, names[top] if len(names) else hashes)
    new = np.append(True, (here[1:] != here[:-1] + 1) | (top[1:] != top[:-1]) | ((top[1:] < 0) & (hashes[1:] != hashes[:-1])))
    cut = np.flatnonzero(new)
    length = np.diff(np.append(cut, len(here)))
    text = owner[here[cut]]
    return name[cut], text, here[cut] - begins[text], length, cut, hashes, (top[cut] < 0) & (length > 1)



_SCHEMA = "name bigint, _id {}, _t binary, first bigint, n bigint, hashes array<bigint>"


def _repeats(rows: DataFrame, shared, window: int, rounds: int, bits: int) -> DataFrame:
    """``_id``, ``_t``, ``first``, ``n``: runs of windows that also start elsewhere."""
    kind = rows.schema["_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            ids, marks = (batch.column(batch.schema.get_field_index(c)) for c in ("_id", "_t"))
            for begin, _, texts in chunks(batch):
                got = _candidates(texts, shared.value, window, rounds, bits)
                if got is None:
                    continue
                name, text, first, length, cut, hashes, equal = got
                sent = np.where(equal, 1, length)  # hashes that say it all
                keys = _mix(_mix(hashes[cut] * _ODD + hashes[cut + length - 1]) + sent.astype(np.uint64) * 2 + equal).tolist()
                if len(seen) > REMEMBERED:
                    seen.clear()
                times = np.empty(len(keys), np.int64)
                for i, (k, e) in enumerate(zip(keys, equal.tolist(), strict=True)):
                    times[i] = seen[k] = seen.get(k, int(e)) + 1
                # met once: to be compared; again, or equal to each other: copies, told once without a place to those elsewhere
                for rows_of, with_id, with_hashes in ((times == 1, True, True), (times == 2, False, True), (times > 1, True, False)):
                    at = np.flatnonzero(rows_of)
                    if not len(at):
                        continue
                    n = sent[at] if with_hashes else np.zeros(len(at), np.int64)
                    lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), pa.array(hashes[ragged(cut[at], n)].view(np.int64)))
                    where = pa.array(begin + text[at]) if with_id else pa.nulls(len(at), pa.int64())
                    at_id, at_mark = ids.take(where), marks.take(where)
                    # what needs no comparison is spread and not brought to its like
                    to = name[at] if with_hashes else _mix(name[at] + (first[at] * 8191 + text[at]).astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(to.view(np.int64)), at_id, at_mark, pa.array(first[at] if with_id else np.full(len(at), -1)), pa.array(length[at]), lists], ["name", "_id", "_t", "first", "n", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "name", 50_000):
            first, n = (table.column(c).to_numpy() for c in ("first", "n"))
            lists = table.column("hashes").combine_chunks()
            offsets = lists.offsets.to_numpy()
            sizes = np.diff(offsets)
            hashes = lists.values.to_numpy()[offsets[0] : offsets[-1]]
            told = np.flatnonzero((sizes == 0) & (first >= 0))
            row = np.repeat(np.arange(len(n)), sizes)
            place = np.repeat(first, sizes) + ragged(np.zeros(len(sizes), np.int64), sizes)
            order = np.argsort(hashes, kind="stable")
            begin = runs(hashes[order])
            times = np.diff(np.append(begin, len(order)))
            often = np.zeros(len(order), bool)
            often[order] = np.repeat(times > 1, times)
            hit = often & (first[row] >= 0)
            row, place = row[hit], place[hit]
            cut = runs(row, place - np.arange(len(place)))
            at = np.append(told, row[cut])
            if len(at):
                out = table.select(["_id", "_t"]).take(pa.array(at)).combine_chunks().to_batches()[0]
                begin, count = np.append(first[told], place[cut]), np.append(n[told], np.diff(np.append(cut, len(row))))
                yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), pa.array(begin), pa.array(count)], ["_id", "_t", "first", "n"])

    found = rows.mapInArrow(find, _SCHEMA.format(kind)).repartition("name").sortWithinPartitions("name")
    return found.mapInArrow(compare, f"_id {kind}, _t binary, first bigint, n bigint")


def _cut(rows: DataFrame, window: int, rounds: int, filter_bits: int) -> DataFrame:
    """``_id``, ``_with``, ``n_words``, ``n_removed``, ``kept``, ``kept_sha256`` per row of ``_id``, ``_text`` and ``_with``."""
    if window < 2:
        raise ValueError("a window has two words or more")
    # ids may be null or repeat: texts under one id are told apart by all 128 bits of a digest
    mark = F.unhex(F.md5("_text")).alias("_t")
    rows = rows.select("_id", "_text", "_with", mark)
    narrow = rows.select("_id", "_text", "_t")
    shared = rows.sparkSession.sparkContext.broadcast(_shared_filter(narrow, window, rounds, filter_bits))
    runs = _repeats(narrow, shared, window, rounds, filter_bits)
    runs = runs.groupBy(F.col("_id").alias("_r"), F.col("_t").alias("_rt")).agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    both = rows.join(runs.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_r")) & (F.col("_t") == F.col("_rt")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, more, runs_of = (batch.column(batch.schema.get_field_index(c)) for c in ("_id", "_with", "runs"))
            for begin, last, texts in chunks(batch):
                n_words, n_removed, kept, digests = [], [], [], []
                for t, found in zip(texts, runs_of.slice(begin, last - begin).to_pylist(), strict=True):
                    words = t.encode().split()
                    n_words.append(len(words))
                    if found:
                        change = np.zeros(len(words) + 1, np.int64)
                        first, n = (np.array([x[c] for x in found]) for c in ("first", "n"))
                        np.add.at(change, first, 1)
                        np.add.at(change, first + n - 1 + window, -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
                    n_removed.append(n_words[-1] - len(words))
                    left = b" ".join(words)
                    kept.append(left.decode())
                    digests.append(hashlib.sha256(left).hexdigest())
                here = slice(begin, last)
                arrays = [ids[here], more[here], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["_id", "_with", "n_words", "n_removed", "kept", "kept_sha256"])

    schema = StructType([*rows.select("_id", "_with").schema, *(StructField(c, LongType()) for c in ("n_words", "n_removed")), *(StructField(c, StringType()) for c in ("kept", "kept_sha256"))])
    return both.select("_id", "_with", "_text", "runs").mapInArrow(cut, schema)


def repeated_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """Per row: ``id_col``, ``n_words``, ``n_removed``, ``kept`` (text of the kept words, joined by a space) and ``kept_sha256``.

    A word goes if a window of ``window`` consecutive words of one text that covers it
    has the same words as a window that starts anywhere else. Null and wordless texts
    have no words. Repeated rows are copies of each other and all windows of theirs
    are repeats. Rows of equal id and text have equal results. An empty table gives an
    empty result.
    """
    rows = texts_of(docs, id_col, text_col, F.lit(0).alias("_with"))
    return _cut(rows, window, rounds, filter_bits).drop("_with").withColumnRenamed("_id", id_col)


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """The rows of ``docs`` with ``text_col`` cut as ``repeated_words`` says, and all their other columns.

    A text without repeats stays to the letter; a row with nothing left of it goes.
    """
    whole = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.struct("*").alias("_with"))
    found = _cut(whole, window, rounds, filter_bits).where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("_with")[text_col]).otherwise(F.col("kept"))
    return found.select(*[text.alias(c) if c == text_col else F.col("_with")[c].alias(c) for c in docs.columns])
