"""SentencePiece encoding and decoding of byte-pair models by suffix-array matching.

The distinct words of a batch (white space marks with what follows them: no piece goes
on after a mark) are one text. A suffix array orders its suffixes, every piece of the
vocabulary finds its range of suffixes by binary search, and the occurrences in these
ranges are the edges of a graph over text positions. Sorted by position they are
relaxed: an edge is taken if its piece may stand after the last piece of the path to
its start, which makes exactly one path of pieces, the one merging would have made.

Two pieces may stand side by side if merging would never join anything across the
boundary between them. Their merges are undone, the latest first, and at each step the
pieces at the boundary must have no earlier merge of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverloop.llm.common import chunks, ragged, texts_of

MARK = "▁"
# Words, and parts of words, that a worker process remembers from task to task, and new ones it matches at once.
REMEMBERED = 250_000
AT_ONCE = 20_000
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_FILTER = 22


@dataclass
class Vocabulary:
    """What encoding and decoding need of a model, as arrays; the size is that of the vocabulary."""

    pieces: list[str]  # that merging can make, longest last
    ids: np.ndarray  # of these pieces
    when: np.ndarray  # order of merges by id; 0: a single character or no piece
    left: np.ndarray  # parts of the last merge, by id; itself if there is none
    right: np.ndarray
    pair_keys: np.ndarray  # id pairs that merge, in order
    pair_when: np.ndarray
    linked: np.ndarray  # pairs of characters that stand side by side in some piece, in order
    marks: dict[int, int]  # ids of pieces of white space marks only, by length
    spelled: list[bytes]  # bytes by id; control pieces are empty
    byte_ids: np.ndarray
    size: int
    name: str  # of the model: a digest of its file

    @property
    def unknown(self) -> int:
        return self.size


def load(path: str) -> Vocabulary:
    """The vocabulary of a model file with byte fallback and plain normalisation."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    if sp.encode("a  Ａ ", out_type=str)[:1] not in (["▁a"], ["▁"]) or sp.encode("ﬁ") == sp.encode("fi"):
        raise ValueError("only models with a leading mark and no character map are read")
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    if any(not sp.is_byte(int(i)) for i in byte_ids):
        raise ValueError("only models with byte fallback are read")
    plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    names = {sp.id_to_piece(i): i for i in plain}
    if MARK not in names or any(MARK in p.lstrip(MARK) for p in names):
        raise ValueError("only models with pieces that start with white space marks or are one are read")
    every = dict(names)
    marks = {len(p): i for p, i in names.items() if not p.strip(MARK)}
    names = {p: i for p, i in names.items() if len(p) == 1 or p.strip(MARK)}
    of_marks = {sp.get_score(i) for n, i in marks.items() if n > 1}
    if len(of_marks) > 1 or max(of_marks, default=-1e30) >= min(sp.get_score(i) for p, i in names.items() if len(p) > 1):
        raise ValueError("pieces of marks only must have the lowest score, all the same")  # they join by place, last of all
    merged = sorted((i for p, i in names.items() if len(p) > 1), key=lambda i: (-sp.get_score(i), len(sp.id_to_piece(i)), i))
    when = np.zeros(size + 1, np.int64)
    when[merged] = np.arange(1, len(merged) + 1)
    left, right = np.arange(size + 1), np.arange(size + 1)
    made = {p for p in names if len(p) == 1}
    for i in merged:
        parts = list(sp.id_to_piece(i))
        while len(parts) > 1:  # merge as the model does: best first, then leftmost
            best = min(((when[names[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in names), default=None)
            if best is None:
                break
            k = best[1]
            if len(parts) == 2:
                if parts[0] in made and parts[1] in made:
                    made.add(parts[0] + parts[1])
                    left[i], right[i] = names[parts[0]], names[parts[1]]
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
    pairs = sorted((names[p[:k]] * (size + 1) + names[p[k:]], int(when[i])) for p, i in names.items() for k in range(1, len(p)) if p[:k] in names and p[k:] in names)
    kept = sorted(made, key=len)
    spelled = [b""] * size
    for p, i in every.items():
        spelled[i] = p.replace(MARK, " ").encode()
    for b, i in enumerate(byte_ids):
        spelled[i] = bytes([b])
    for i in range(size):
        if sp.is_unknown(i):
            spelled[i] = " ⁇ ".encode()
    keys, times = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    linked = np.unique(np.array([(ord(a) << 32) + ord(b) for p in kept for a, b in zip(p, p[1:], strict=False)], np.int64))
    with open(path, "rb") as file:
        name = hashlib.sha256(file.read()).hexdigest()
    return Vocabulary(kept, np.array([names[p] for p in kept]), when, left, right, keys, times, linked, marks, spelled, byte_ids, size, name)


def _filter_at(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER)).astype(np.int64)


class Encoder:
    """Encodes texts of one task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.known: dict[str, bytes] = {}  # by words without the mark they begin with
        self.units: dict[str, bytes] = {}  # by parts of words that merging never joins to others
        self.maybe = np.zeros(1 << _FILTER, bool)
        self.maybe[_filter_at(vocabulary.pair_keys)] = True
        # pieces in order of their characters, so that searches for them go through the suffixes once
        order = sorted(range(len(vocabulary.pieces)), key=vocabulary.pieces.__getitem__)
        self.flat = np.frombuffer("".join([vocabulary.pieces[i] for i in order]).encode("utf-32-le"), "<u4")
        self.ids = vocabulary.ids[order].astype(np.int32)
        self.lengths = np.array([len(vocabulary.pieces[i]) for i in order])
        self.length_of = np.ones(vocabulary.size + 1, np.int64)
        self.length_of[self.ids] = self.lengths

    def _merge_time(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """When a pair merges; a large number if it never does."""
        keys = a.astype(np.int64) * (self.v.size + 1) + b
        out = np.full(len(keys), 1 << 40)
        some = np.flatnonzero(self.maybe[_filter_at(keys)])
        place = np.minimum(np.searchsorted(self.v.pair_keys, keys[some]), len(self.v.pair_keys) - 1)
        hit = self.v.pair_keys[place] == keys[some]
        out[some[hit]] = self.v.pair_when[place[hit]]
        return out

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of pieces as it is."""
        v, ok = self.v, np.ones(len(a), bool)
        open_, limit = np.arange(len(a)), np.full(len(a), 1 << 39)
        while len(open_):
            early = self._merge_time(a, b) < limit
            ok[open_[early]] = False
            wa, wb = v.when[a], v.when[b]
            go = ~early & ((wa > 0) | (wb > 0))
            open_, a, b, wa, wb = open_[go], a[go], b[go], wa[go], wb[go]
            first = wa > wb  # the left piece was made last
            # of equal merges the left one comes first
            limit = np.where(first, wa, wb + 1)
            a, b = np.where(first, v.right[a], a), np.where(first, b, v.left[b])
        return ok

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and id of every occurrence of every piece in a text."""
        n, width = len(codes), int(self.lengths.max())
        used = np.zeros(0x110000, bool)
        used[codes] = True
        letters = np.flatnonzero(used)
        number = np.cumsum(used, dtype=np.int32)  # 0 stands for what is behind the text
        kind, top = (">u2", 0xFFFF) if len(letters) < 0xFFFF else (">u4", 0xFFFFFFFF)
        text = np.append(number[codes], np.zeros(width, np.int32))
        # as many characters as fit into an integer, then prefix doubling
        bits = len(letters).bit_length()
        covered = min(width, 62 // bits)
        dense = np.zeros(n, np.int64)
        for i in range(covered):
            dense = (dense << bits) | text[i : i + n]
        while covered < width:
            dense = np.unique(dense, return_inverse=True)[1]
            after = np.zeros(n, np.int64)
            after[: max(0, n - covered)] = dense[covered:] + 1
            dense = dense * (n + 1) + after
            covered *= 2
        order = np.argsort(dense)
        size_of = np.dtype(kind).itemsize * width
        suffixes = np.lib.stride_tricks.sliding_window_view(text.astype(kind), width)[order].view(f"S{size_of}").ravel()
        starts = np.cumsum(self.lengths) - self.lengths
        usable = np.flatnonzero(np.logical_and.reduceat(used[self.flat], starts))
        low = np.zeros((len(usable), width), kind)
        size = self.lengths[usable]
        low[np.repeat(np.arange(len(usable)), size), ragged(np.zeros(len(size), np.int64), size)] = number[self.flat[ragged(starts[usable], size)]]
        high = low.copy()
        high[np.arange(width) >= size[:, None]] = top
        a = np.searchsorted(suffixes, low.view(f"S{size_of}").ravel(), "left")
        b = np.searchsorted(suffixes, high.view(f"S{size_of}").ravel(), "right")
        count = b - a
        return order[ragged(a, count)].astype(np.int32), np.repeat(size.astype(np.int32), count), np.repeat(self.ids[usable], count)

    def _marks(self, n: int) -> bytes:
        """Ids of ``n`` marks in a row: the leftmost two neighbours that make a piece join, again and again."""
        stack: list[int] = []
        for _ in range(n):
            top = 1
            while stack and stack[-1] + top in self.v.marks:
                top += stack.pop()
            stack.append(top)
        return np.array([self.v.marks[k] for k in stack], "<i4").tobytes()

    def _paths(self, units: list[str]) -> list[bytes]:
        """Ids of every unit, the path of pieces through it."""
        v = self.v
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer("\0".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
        begins = np.cumsum(lengths + 1) - (lengths + 1)
        start, size, piece = self._edges(codes)
        # characters without a piece of their own are edges too; separators are none
        single = np.zeros(len(codes), bool)
        single[start[size == 1]] = True
        inside = np.ones(len(codes), bool)
        inside[begins[1:] - 1] = False
        lone = np.flatnonzero(inside & ~single).astype(np.int32)
        start, size, piece = np.append(start, lone), np.append(size, np.ones(len(lone), np.int32)), np.append(piece, np.full(len(lone), v.unknown, np.int32))
        unit_of = np.repeat(np.arange(len(units)), lengths + 1)  # a separator counts with the unit before it
        place = start - begins[unit_of[start]]
        place = place.astype(np.uint16 if lengths.max() <= 0xFFFF else np.int32)
        order = np.argsort(place, kind="stable")
        start, size, piece, place = start[order], size[order], piece[order], place[order]
        last = np.full(len(codes) + 1, -1, np.int32)  # by end position: the last piece of the path
        cuts = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(place))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            s, t, e = start[a:b], piece[a:b], start[a:b] + size[a:b]
            if place[a]:
                # ends are counted from the position after the piece; a unit's own first position has no path before it
                before = last[s]
                on = before >= 0
                s, t, e, before = s[on], t[on], e[on], before[on]
                fits = self.side_by_side(before, t)
                t, e = t[fits], e[fits]
            last[e] = t
        # back from the ends of all paths at once
        on_path = np.zeros(len(codes) + 1, bool)
        now, floor = begins + lengths, begins
        while len(now):
            on_path[now] = True
            now = now - self.length_of[last[now]]
            more = now > floor
            now, floor = now[more], floor[more]
        ends = np.flatnonzero(on_path)
        ids, unit = last[ends], unit_of[ends - 1]
        strange = np.flatnonzero(ids == v.unknown)
        if len(strange):
            spelled = [v.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))].astype(np.int32) for c in codes[ends[strange] - 1].tolist()]
            extra = np.ones(len(ids), np.int64)
            extra[strange] = [len(x) for x in spelled]
            out = np.repeat(ids, extra)
            out[np.repeat(ids == v.unknown, extra)] = np.concatenate(spelled)
            ids, unit = out, np.repeat(unit, extra)
        per_unit = np.bincount(unit, minlength=len(units)) * 4
        raw, stops = ids.astype("<i4").tobytes(), np.cumsum(per_unit)
        return [raw[b - n : b] for b, n in zip(stops.tolist(), per_unit.tolist(), strict=True)]

    def _match(self, words: list[str]) -> list[bytes]:
        """Ids of every word; a word begins with a mark."""
        v, text = self.v, "\0".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        begins = np.cumsum(lengths + 1) - (lengths + 1)
        # nothing joins characters that are side by side in no piece: words are cut there
        pair = (codes[:-1].astype(np.int64) << 32) + codes[1:]
        cut = np.ones(len(codes), bool)
        cut[1:] = v.linked[np.minimum(np.searchsorted(v.linked, pair), len(v.linked) - 1)] != pair
        cut[begins] = True
        cut[begins[1:] - 1] = True
        at = np.flatnonzero(cut)
        stop = np.append(at[1:], len(codes))
        within = np.ones(len(codes) + 1, bool)
        within[begins[1:] - 1] = False
        real = within[at]  # and no separator between words
        at, stop = at[real], stop[real]
        units = [text[a:b] for a, b in zip(at.tolist(), stop.tolist(), strict=True)]
        known = self.units
        new = list(set(units).difference(known))
        for a in range(0, len(new), AT_ONCE):
            part = new[a : a + AT_ONCE]
            known.update(zip(part, self._paths(part), strict=True))
        spelled = list(map(known.__getitem__, units))
        raw, stops = b"".join(spelled), np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled)))
        stops = stops[np.append(np.searchsorted(at, begins[1:]), len(at)) - 1].tolist()
        out = [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        mark = np.array([v.marks[1]], "<i4").tobytes()
        for i, word in enumerate(words):
            if word.startswith(MARK + MARK):
                n, most = 0, len(word) - len(word.lstrip(MARK))
                while n < most and out[i][4 * n : 4 * n + 4] == mark:
                    n += 1
                out[i] = self._marks(n) + out[i][4 * n :]
        return out

    @staticmethod
    def _words(text: str) -> list[str]:
        """Words of a text, each without the mark it begins with."""
        if not text:
            return []
        if text[0] != " " and "  " not in text and MARK not in text:
            return text.split(" ")
        return [w[1:] for w in _WORD.findall(MARK + text.replace(" ", MARK))]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian 32-bit integers."""
        split = list(map(self._words, texts))
        # the first ones met are the most frequent ones
        if len(self.known) > REMEMBERED:
            self.known = dict(islice(self.known.items(), REMEMBERED // 2))
        if len(self.units) > REMEMBERED:
            self.units = dict(islice(self.units.items(), REMEMBERED // 2))
        known = self.known
        new = list(set(chain.from_iterable(split)).difference(known))
        for a in range(0, len(new), AT_ONCE):
            part = new[a : a + AT_ONCE]
            known.update(zip(part, self._match([MARK + w for w in part]), strict=True))
        return [b"".join(map(known.__getitem__, words)) for words in split]


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """One per worker process, as tasks follow each other in it."""
    if vocabulary.name not in _encoders:
        _encoders[vocabulary.name] = Encoder(vocabulary)
    return _encoders[vocabulary.name]


def _lists(raw: list[bytes]) -> pa.Array:
    counts = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(counts)).astype(np.int32), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of ids) of every row.

    Null and empty texts have no ids. A white space mark in a text counts as a space.
    Characters without a piece become the pieces of their bytes. Repeated rows give
    repeated rows.
    """
    rows = texts_of(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("_id"))
            for first, last, texts in chunks(batch):
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), _lists(encoder(texts))], ["_id", "ids"])

    return rows.mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


class Decoder:
    """Texts of lists of ids."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.spelled = pa.array(vocabulary.spelled, pa.large_binary())

    def __call__(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The text of every list, which ``offsets`` part."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.spelled)):
            raise ValueError("an id is outside the vocabulary")
        made = self.spelled.take(pa.array(ids))
        _, stops, data = made.buffers()
        raw = memoryview(data or b"")
        stops = np.frombuffer(stops, np.int64, len(made) + 1)[offsets] if len(made) else offsets
        # the space that encoding puts before a text goes
        return pa.array([str(raw[a + (raw[a : min(a + 1, b)] == b" ") : b], "utf-8", "replace") for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)], pa.string())


def _of_lists(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of lists, from 0."""
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0], lists.values.to_numpy()[offsets[0] : offsets[-1]]


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``ids_col`` and ``text`` of every row of ids.

    The space that encoding puts before a text goes. Control pieces are nothing, bytes
    that are no UTF-8 become U+FFFD, null and empty lists are empty texts. An id outside
    the vocabulary is an error.
    """
    rows = encoded.select(F.col(id_col).alias("_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("_ids"))
    kind = rows.schema["_id"].dataType.simpleString()
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("_ids"))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("_id")), lists, decoder(*_of_lists(lists))], ["_id", "_ids", "text"])

    return rows.mapInArrow(run, f"_id {kind}, _ids array<int>, text string").withColumnsRenamed({"_id": id_col, "_ids": ids_col})


def encode_and_decode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode`` of ``encode``: ``id_col``, ``ids`` and the ``text`` that the ids stand for.

    Both are done in one pass. As two, every task would hold two Python workers, and as workers
    take turns, all of them would come to remember words.
    """
    rows = texts_of(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(sent.value), Decoder(sent.value)
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("_id"))
            for first, last, texts in chunks(batch):
                lists = _lists(encoder(texts))
                yield pa.RecordBatch.from_arrays([keys.slice(first, last - first), lists, decoder(*_of_lists(lists))], ["_id", "ids", "text"])

    return rows.mapInArrow(run, f"_id {kind}, ids array<int>, text string").withColumnRenamed("_id", id_col)
