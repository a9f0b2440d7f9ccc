"""Periodic runs of words, from Lyndon arrays made by the first phase of a suffix sorter.

The sorter (Baier's grouping) deals the suffixes of a text to groups by their longest
Lyndon prefix, from the highest group to the lowest. When a group's turn comes, each of
its suffixes looks back for the nearest suffix that had no turn yet; that one's prefix
is followed by as many copies of the group's prefix as suffixes look at it, so it moves
to a new group right above its own. The length of a group's prefix at its turn is the
Lyndon array of its suffixes; nothing needs the second phase that sorts inside groups.

Every run has a root that is the longest Lyndon word at its place under the order of
the words or under the reversed one. So both arrays are made, and each of their words is
extended to both sides as far as its period goes on.

A run of the length and exponent asked for lies where windows of words repeat in the
text; only such stretches are sorted, which loses none (see ``stretches``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverloop.llm.common import chunks, texts_of

MIN_WORDS = 24
MIN_EXPONENT = 3

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def lyndon_array(ranks: list[int], n_ranks: int) -> np.ndarray:
    """Length of the longest Lyndon word at each place of a row of ranks 0 to ``n_ranks`` - 1, by grouping."""
    n = len(ranks)
    out = np.empty(n, np.int64)
    group_of = list(ranks)
    members: list[list[int]] = [[] for _ in range(n_ranks)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    size = [1] * n_ranks  # of the prefix that a group stands for
    below, above = list(range(-1, n_ranks - 1)), list(range(1, n_ranks + 1))
    back = list(range(-1, n - 1))  # towards the nearest place without a turn
    done = bytearray(n)
    top = n_ranks - 1
    while top >= 0:
        turn = [s for s in members[top] if group_of[s] == top]
        members[top] = []
        length = size[top]
        for s in turn:
            done[s] = 1
        out[turn] = length
        looked: dict[int, int] = {}
        for s in turn:
            p = back[s]
            while p >= 0 and done[p]:
                q = back[p]
                if q >= 0 and done[q]:
                    back[p] = back[q]
                p = q
            back[s] = p
            if p >= 0:
                looked[p] = looked.get(p, 0) + 1
        if len(looked) == 1:
            ((p, k),) = looked.items()
            moved = {(k, group_of[p]): [p]}
        else:
            moved = {}
            for p, k in looked.items():
                moved.setdefault((k, group_of[p]), []).append(p)
        for k, g in sorted(moved, reverse=True) if len(moved) > 1 else moved:
            new, places = len(size), moved[k, g]
            size.append(size[g] + k * length)
            members.append(places)
            for p in places:
                group_of[p] = new
            over = above[g]
            below.append(g)
            above.append(over)
            above[g] = new
            if over < len(below) and below[over] == g:
                below[over] = new
        top = below[top]
    return out


def _agree(words: np.ndarray, a: int, b: int) -> int:
    """How many words agree from ``a`` and from ``b`` on, ``a`` before ``b``."""
    n, at, step = len(words), 0, 64
    while b + at < n:
        stop = min(step, n - b - at)
        differ = words[a + at : a + at + stop] != words[b + at : b + at + stop]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + stop, step * 2
    return at


def _agree_before(words: np.ndarray, a: int, b: int) -> int:
    """How many words agree before ``a`` and before ``b``, ``a`` before ``b``."""
    at, step = 0, 64
    while a - at > 0:
        stop = min(step, a - at)
        differ = words[a - at - stop : a - at] != words[b - at - stop : b - at]
        if differ.any():
            return at + int(differ[::-1].argmax())
        at, step = at + stop, step * 2
    return at


def runs_of(words: np.ndarray, min_words: int = 2, min_exponent: int = 2) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of a row of ranks, by start, then period.

    A run has at least ``min_words`` words and ``min_exponent`` (2 or more) periods.
    """
    n, n_ranks = len(words), int(words.max()) + 1 if len(words) else 0
    found: set[tuple[int, int, int]] = set()
    for ranks in (words, n_ranks - 1 - words):
        period = lyndon_array(ranks.tolist(), n_ranks)
        root = np.arange(n)
        after, before = root + period, root - 1
        # a run is longer than its root by a word at one end at least
        on = (after < n) & (words[np.minimum(after, n - 1)] == words)
        on |= (before >= 0) & (words[np.maximum(before, 0)] == words[after - 1])
        root, period = root[on], period[on]
        order = np.lexsort((root, period))
        end = {}
        for i, q in zip(root[order].tolist(), period[order].tolist(), strict=True):
            if i + q <= end.get(q, 0):  # inside the last run of that period
                continue
            stop = i + q + _agree(words, i, i + q)
            start = i - _agree_before(words, i, i + q)
            end[q] = stop
            if stop - start >= max(min_words, min_exponent * q):
                found.add((start, stop - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(hashes: np.ndarray, min_words: int, min_exponent: int) -> list[tuple[int, int]]:
    """Where runs can be: ``(start, end)`` of stretches of words in windows that the text has twice or more.

    A run of period q has ``length - q`` words that come again q words later. These are
    ``min_words * (min_exponent - 1) / min_exponent`` or more, whatever q is. So with windows of that
    many words, all windows in the run's words but the last q are in the text again, and so
    are those in its words but the first q; together they cover the run.
    """
    window = math.ceil(min_words * (min_exponent - 1) / min_exponent)
    n = len(hashes) - window + 1
    if n < 2:
        return []
    part, done, rolled, covered, left = hashes, 1, None, 0, window
    while left:  # windows from halves of windows
        if left & 1:
            rolled = part[covered:] if rolled is None else rolled[: len(part) - covered] * _ODD + part[covered:]
            covered += done
        left >>= 1
        if left:
            part, done = _mix(part[:-done] * _ODD + part[done:]), done * 2
    rolled = rolled[:n]
    order = np.argsort(rolled)
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return []
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    cover[:n] += again
    cover[window : window + n] -= again
    change = np.diff(np.concatenate([[0], np.cumsum(cover[:-1]) > 0, [0]]).astype(np.int8))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    long = ends - starts >= min_words
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def text_runs(words: list[bytes], min_words: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """The runs of one text, by start, then period."""
    if len(words) < min_words:
        return []
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = []
    for a, b in stretches(hashes, min_words, min_exponent):
        part = words[a:b]
        rank = {w: i for i, w in enumerate(sorted(set(part)))}
        out += [(a + s, n, q) for s, n, q in runs_of(np.array([rank[w] for w in part]), min_words, min_exponent)]
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def _collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    change = np.zeros(len(words) + 1, np.int64)
    for start, n, q in found:
        change[start + q] += 1
        change[start + n] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Per row: ``id_col``, ``n_words``, ``runs`` (array of ``start``, ``length``, ``period``) and ``collapsed``.

    A run is a stretch of words with smallest period q that no neighbouring word extends,
    of ``min_words`` words and ``min_exponent`` periods or more, by start, then period. ``collapsed``
    is the text without the words that a run has after its first period, one space
    between words. Null, empty and wordless texts have no words and no runs, and
    ``collapsed`` is empty. Rows are independent: repeated rows, null and repeated ids give
    a row each; an empty table gives an empty result.
    """
    if min_exponent < 2 or min_words < 2:
        raise ValueError("a run has two words and two periods or more")
    rows = texts_of(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    listed = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("_id"))
            for first, last, texts in chunks(batch):
                n_words, found, kept = [], [], []
                for t in texts:
                    words = t.encode().split()
                    of_text = text_runs(words, min_words, min_exponent)
                    n_words.append(len(words))
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in of_text])
                    kept.append((_collapse(words, of_text) if of_text else b" ".join(words)).decode())
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(n_words, pa.int64()), pa.array(found, listed), pa.array(kept, pa.string())], ["_id", "n_words", "runs", "collapsed"])

    made = rows.mapInArrow(run, f"_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return made.withColumnRenamed("_id", id_col)


def steepest(runs) -> F.Column:
    """The run of the greatest exponent: smallest start, then period, among equals; null if there is none."""
    more = lambda a, b: F.when(a["length"] * b["period"] >= b["length"] * a["period"], a).otherwise(b)  # noqa: E731  fractions compared exactly
    return F.reduce(F.slice(runs, F.lit(2), F.size(runs)), F.get(runs, F.lit(0)), lambda best, r: more(best, r))
