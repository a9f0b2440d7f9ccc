"""Alignment of two tokenizers over the same bytes, and the weight of the pairs it links.

A byte-level tokenizer (A) and a SentencePiece model (B) cut one text, a space and the
document. The tokenizers library tells where A's tokens lie in characters, the
processor's spans where B's lie in bytes (the installed version has no immutable proto;
its offset mapping gives the same begins and ends). These spans are the coarse cuts. Tokens that share
a character, as parts of its bytes do, have no cut of their own there: they are refined
by the bytes they decode to. Where tokens of both end together, a group ends.

Both tokenizers end a token before a space between two characters that are none, around a
lone line break, and between a letter and a stop. So a text is cut there, and parts that
come again are aligned once per process. ``_Aligner`` asks the vocabulary whether that
holds and keeps texts whole where it does not.

Two tokens that end together are one a suffix of the other, so all pairs that can ever be
linked follow from the vocabularies alone: their number is known before a text is read,
and the corpus-wide counts are an array of that size.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverloop.llm.common import chunks, texts_of

# Parts a worker process remembers from task to task, and new ones it encodes at once.
# What a part takes, some 300 bytes, counts for both workers of an executor of two cores.
REMEMBERED = 250_000
AT_ONCE = 5_000
# Bytes of text a task works on at a time.
STEP_CHARS = 1_000_000
STOPS = ",."
MARK = "▁"
_LOOSE = re.compile(r" (?=\s|$)")
_CUT = re.compile(r"(?<=[^ ]) (?=\S)")


def _byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def spelled_bytes(tokenizer) -> list[bytes]:
    """Bytes by id of a byte-level tokenizer; special tokens have none."""
    letters = _byte_alphabet()
    special = tokenizer.get_added_tokens_decoder()
    out = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        if i not in special:
            out[i] = bytes([letters[c] for c in token])
    return out


def spelled_pieces(processor) -> list[bytes]:
    """Bytes by id of a SentencePiece model; control pieces have none."""
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            out.append(bytes([int(piece[3:-1], 16)]))
        elif processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i):
            out.append(b"")
        else:
            out.append(piece.replace(MARK, " ").encode())
    return out


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """``id of A * len(b) + id of B``, ascending, of all pairs of which one spells a suffix of the other."""
    found = set()
    for left, right, swapped in ((a, b, False), (b, a, True)):
        ids: dict[bytes, list[int]] = {}
        for j, x in enumerate(right):
            if x:
                ids.setdefault(x, []).append(j)
        for i, x in enumerate(left):
            for k in range(len(x)):
                for j in ids.get(x[k:], ()):
                    found.add(j * len(b) + i if swapped else i * len(b) + j)
    return np.array(sorted(found), np.int64)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All values of the lists, and the length of each."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts


class _Aligner:
    def __init__(self, byte_path: str, piece_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True  # their strings in a text are text
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a_bytes, self.b_bytes = spelled_bytes(self.a), spelled_pieces(self.b)
        self.a_lengths, self.b_lengths = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.pairs = possible_pairs(self.a_bytes, self.b_bytes)
        size = max(len(self.a_bytes), len(self.b_bytes))
        self.names = {c: np.array([f"{i}{c}" for i in range(size)], object) for c in ",|;"}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        # cuts that no piece goes across
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.breaks = self.cuts and not any("\n" in p for p in pieces)
        crossed = {y for p in pieces for x, y in zip(p, p[1:], strict=False) if x.isalpha()}
        self.stops = frozenset(s for s in STOPS if self.breaks and s not in crossed)
        # (tokens of A << 32) + tokens of B, groups, places of the links' pairs; None: bytes differ
        self.known: dict[str, tuple[int, str, bytes] | None] = {}  # by parts, which a space stands before
        self.inner: dict[str, tuple[int, str, bytes] | None] = {}  # by what starts with a line break, and stops
        if self.stops:
            self._encode(["\n", *(f"\n{s}" for s in self.stops)])
            lone = self.inner["\n"]
            for s in self.stops:
                n, groups, links = self.inner[f"\n{s}"]
                self.inner[s] = (n - lone[0], groups[len(lone[1]) + 1 :], links[len(lone[2]) :])
        self.always = len(self.inner)

    def _encode(self, atoms: list[str]) -> None:
        """Aligns atoms, which start with a space or a line break, and remembers them."""
        for first in range(0, len(atoms), AT_ONCE):
            part = atoms[first : first + AT_ONCE]
            for atom, entry in zip(part, self._aligned(part), strict=True):
                if atom[0] == " ":
                    self.known[atom[1:]] = entry
                else:
                    self.inner[atom] = entry

    @staticmethod
    def _ends(counts: np.ndarray, lengths: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Where tokens end in the bytes of all atoms: by their spans, or by the bytes they decode to where spans
        are empty or share a character."""
        of = np.repeat(np.arange(len(counts)), counts)
        decoded = np.cumsum(lengths)
        before = np.append(0, decoded)[np.cumsum(counts) - counts]
        same = of[1:] == of[:-1]
        clear = ~same | (ends[:-1] <= starts[1:])
        alone = (starts < ends) & np.append(True, clear) & np.append(clear, True)
        return np.where(alone, ends, decoded - before[of] + base[of])

    def _aligned(self, atoms: list[str]) -> list[tuple[int, str, bytes] | None]:
        """Tokens, groups and links of every atom; None where the bytes differ."""
        lefts = self.a.encode_batch(atoms, add_special_tokens=False)
        rights = self.b.encode([x[1:] if x[0] == " " else x for x in atoms], return_type="offset_mapping", return_bytes=True, num_threads=1)
        flat, texts = "".join(atoms).encode(), [x.encode() for x in atoms]
        base = np.cumsum([0, *map(len, texts[:-1])])
        # A: spans of characters, turned into bytes
        a_ids, n_a = _flat([x.ids for x in lefts])
        spans = np.fromiter(chain.from_iterable(y for x in lefts for y in x.offsets), np.int64, 2 * len(a_ids)).reshape(-1, 2)
        raw = np.frombuffer(flat, np.uint8)
        byte_of = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        spans = byte_of[spans + np.repeat(np.cumsum([0, *map(len, atoms[:-1])]), n_a)[:, None]]
        a_ends = self._ends(n_a, self.a_lengths[a_ids], spans[:, 0], spans[:, 1], base)
        # B: spans of bytes, without the space that it adds; before a line break that space is no part of the atom
        spaced = [x[0] == " " for x in atoms]
        b_ids, n_b = _flat([x["ids"] if y else x["ids"][1:] for x, y in zip(rights, spaced, strict=True)])
        places = [x["offsets"] if y else x["offsets"][1:] for x, y in zip(rights, spaced, strict=True)]
        places = np.fromiter(chain.from_iterable(y for x in places for y in x), np.int64, 2 * len(b_ids)).reshape(-1, 2) + np.repeat(base + spaced, n_b)[:, None]
        places[(np.cumsum(n_b) - n_b)[n_b > 0], 0] = base[n_b > 0]
        b_ends = self._ends(n_b, self.b_lengths[b_ids], places[:, 0], places[:, 1], base)
        good = np.ones(len(atoms), bool)
        for ids, counts, spelled in ((a_ids, n_a, self.a_bytes), (b_ids, n_b, self.b_bytes)):
            made = [spelled[i] for i in ids.tolist()]
            if b"".join(made) != flat:
                stops = np.cumsum(counts).tolist()
                good &= [b"".join(made[z - n : z]) == t for z, n, t in zip(stops, counts.tolist(), texts, strict=True)]
        if not good.all():
            again = iter(self._aligned([x for x, y in zip(atoms, good, strict=True) if y]) if good.any() else ())
            return [next(again) if y else None for y in good.tolist()]
        # tokens that end together close a group; the tokens of a group in order, A's first
        a_last, b_last = np.isin(a_ends, b_ends, assume_unique=True), np.isin(b_ends, a_ends, assume_unique=True)
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        names = np.where(a_last, self.names["|"][a_ids], self.names[","][a_ids])
        names = np.concatenate([names, np.where(b_last, self.names[";"][b_ids], self.names[","][b_ids])])[order].tolist()
        pairs = a_ids[a_last] * len(self.b_bytes) + b_ids[b_last]
        links = np.searchsorted(self.pairs, pairs).astype("<i4").tobytes()
        name_stops = np.cumsum(n_a + n_b).tolist()
        link_stops = (4 * np.cumsum(np.add.reduceat(a_last, np.cumsum(n_a) - n_a, dtype=np.int64))).tolist()
        counts = ((n_a << 32) + n_b).tolist()
        name_starts, link_starts = [0, *name_stops[:-1]], [0, *link_stops[:-1]]
        return [(n, "".join(names[i:j])[:-1], links[k:m]) for n, i, j, k, m in zip(counts, name_starts, name_stops, link_starts, link_stops, strict=True)]

    def _atoms(self, part: str) -> list[tuple[dict, str]]:
        """What a part is made of: where each is remembered, and its name there."""
        lines = part.split("\n") if self.breaks else [part]
        if len(lines) > 1 and not all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
            lines = [part]
        out = []
        for k, x in enumerate(lines):
            word, where = (f"\n{x}", self.inner) if k else (x, self.known)
            if len(x) > 1 and x[-1] in self.stops and x[-2].isalpha():
                out += [(where, word[:-1]), (self.inner, x[-1])]
            else:
                out.append((where, word))
        return out

    def _learn(self, parts: Iterable[str]) -> dict[str, tuple[int, str, bytes] | None]:
        """Remembers atoms; returns the parts that are made of several."""
        alone, made = [], {}
        for p in parts:
            if p and ("\n" in p or p[-1] in self.stops) and len(atoms := self._atoms(p)) > 1:
                made[p] = atoms
            else:
                alone.append(f" {p}")
        within = {f" {x}" if where is self.known else x for atoms in made.values() for where, x in atoms if x not in where}
        self._encode(alone + list(within.difference(alone)))
        for p, atoms in made.items():
            got = [where[x] for where, x in atoms]
            made[p] = None if None in got else (sum(x[0] for x in got), ";".join([x[1] for x in got]), b"".join([x[2] for x in got]))
        return made

    def parts(self, text: str) -> list[str]:
        """Parts of a text that is not empty; each stands for itself with a space before it."""
        if not self.cuts:
            return [text]
        return _CUT.split(text) if text[0] == " " or _LOOSE.search(text) else text.split(" ")

    def __call__(self, texts: list[str]) -> list[tuple[int, str, bytes] | None]:
        """Tokens, groups and links of every text; None without tokens."""
        split = [self.parts(t) if t else [] for t in texts]
        absent = set(chain.from_iterable(split)).difference(self.known)
        composed = self._learn(absent) if absent else {}
        self.known.update(composed)  # for these texts only: memory is for atoms
        out = []
        for parts in split:
            got = list(map(self.known.__getitem__, parts))
            if not got or None in got:
                out.append(None)
                continue
            counts, groups, links = zip(*got, strict=True)
            out.append((sum(counts), ";".join(groups), b"".join(links)))
        for p in composed:
            del self.known[p]
        if len(self.known) + len(self.inner) > REMEMBERED:  # the first ones met are the most frequent ones
            self.known = dict(islice(self.known.items(), REMEMBERED // 2))
            self.inner = dict(islice(self.inner.items(), max(self.always, REMEMBERED // 8)))
        return out


@cache
def _aligner(byte_path: str, piece_path: str) -> _Aligner:
    """One per worker process, as tasks follow each other in it."""
    return _Aligner(byte_path, piece_path)


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``n_a``, ``n_b``, ``groups`` and ``links``.

    ``groups`` holds the ids of both in order, ``a1,a2|b1;a3|b2,b3``, a group wherever tokens
    of both end together; ``links`` has for each of these ends the number of the pair of
    tokens that end there (its place among ``possible_pairs``). Null and empty texts, and those
    that one of the tokenizers does not give back byte by byte (as one with the white space
    mark of B), have no tokens: zeros, an empty string, an empty array. Rows are
    independent: repeated rows and null ids give a row each, an empty table an empty result.
    """
    rows = texts_of(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_path, piece_path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("_id"))
            for first, last, texts in chunks(batch, STEP_CHARS):
                got = [x or (0, "", b"") for x in aligner(texts)]
                counts = np.array([x[0] for x in got], np.int64)
                offsets = np.append(0, np.cumsum([len(x[2]) // 4 for x in got])).astype(np.int32)
                links = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join([x[2] for x in got]), "<i4")))
                groups = pa.array([x[1] for x in got], pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(counts >> 32), pa.array(counts & 0xFFFFFFFF), groups, links], ["_id", "n_a", "n_b", "groups", "links"])

    made = rows.mapInArrow(run, f"_id {kind}, n_a bigint, n_b bigint, groups string, links array<int>")
    return made.withColumnRenamed("_id", id_col)


def _link_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of the lists of a batch."""
    lists = batch.column(batch.schema.get_field_index("links"))
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0], lists.values.to_numpy()[offsets[0] : offsets[-1]]


def link_counts(aligned: DataFrame, n_pairs: int) -> np.ndarray:
    """How often each possible pair is linked; tasks add up what they meet, so an array of ``n_pairs`` is the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            total += np.bincount(_link_arrays(batch)[1], minlength=n_pairs)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["pair", "n"])

    found = aligned.select("links").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_pairs, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def weigh(aligned: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id") -> DataFrame:
    """``aligned``, a stored table, with ``n_links``, ``n_best`` and ``count_sum`` in place of ``links``.

    A pair's count is how many links of all rows hold it. ``n_best`` counts the links whose
    pair has the highest count of all pairs with its token of B, ``count_sum`` adds their counts.
    """
    aligner = _aligner(byte_path, piece_path)
    pairs, size = aligner.pairs, len(aligner.b_bytes)
    counts = link_counts(aligned, len(pairs))
    highest = np.zeros(size, np.int64)
    np.maximum.at(highest, pairs % size, counts)
    sent = aligned.sparkSession.sparkContext.broadcast((counts, counts == highest[pairs % size]))
    kept = [f for f in aligned.schema.fields if f.name != "links"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_links bigint, n_best bigint, count_sum bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = sent.value
        for batch in batches:
            offsets, links = _link_arrays(batch)
            sums = [np.append(0, np.cumsum(x[links], dtype=np.int64))[offsets] for x in (best, count)]
            rest = batch.select([f.name for f in kept])
            arrays = [*rest.columns, pa.array(np.diff(offsets).astype(np.int64)), *(pa.array(np.diff(x)) for x in sums)]
            yield pa.RecordBatch.from_arrays(arrays, [*rest.schema.names, "n_links", "n_best", "count_sum"])

    return aligned.mapInArrow(run, schema)
