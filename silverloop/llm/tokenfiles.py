"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus, the most frequent being 0, so that most
take one byte. A folder holds ``ranks.bin`` (the ids in order of rank, 4 bytes each)
and shards in ascending order of document. A shard is a row of blocks::

    lengths of the four sections below, and the number of ids: 5 x uint32
    keys      JSON list of the documents' keys
    counts    uint32 per document: its ids
    control   2 bits per id, four to a byte, lowest first: bytes of its rank less one
    data      the ranks' bytes, little-endian

All integers are little-endian. Control bytes stand apart from data, so that a table
of 256 rows gives the lengths of four ids at once.
"""

from __future__ import annotations

import json
import os
import re
import struct
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from silverloop.llm.common import chunks, ragged, stage, texts_of
from silverloop.llm.files import Ranges, write_whole

END = 0
HEAD = "<5I"
BLOCK_CHARS = 2_000_000
BLOCK_IDS = 1_000_000
# Words a worker process remembers from task to task, new ones that are one text to the model, and texts it encodes at once.
REMEMBERED = 1_500_000
JOINED = 200
AT_ONCE = 100
_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)
STOPS = ",."
LEADS = {" ": "Ġ", "\n": "Ċ"}  # fixed values: how the model's file writes these
_LOOSE = re.compile(r" (?=\s|$)")
# The same for arrays, whose patterns know fewer spaces by name.
_LOOSE_RE2 = " ([" + "".join(f"\\x{{{c:X}}}" for c in range(0x3001) if chr(c).isspace()) + "]|$)"


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit integers."""
    v = values.astype("<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    starts = np.cumsum(code, dtype=np.int64) - code + np.arange(len(v))
    data = np.empty(len(v) + int(code.sum()), np.uint8)
    data[starts] = v.astype(np.uint8)
    for i in range(1, int(code.max(initial=0)) + 1):
        more = np.flatnonzero(code >= i)
        data[starts[more] + i] = (v[more] >> np.uint32(8 * i)).astype(np.uint8)
    four = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    four[: len(v)] = code
    four = four.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` integers packed."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    if len(ends) and ends[-1] != len(data):
        raise ValueError("control bytes and data don't fit together")
    raw, starts = np.frombuffer(data, np.uint8), ends - lengths
    out = raw[starts].astype(np.uint32)
    for i in range(1, int(lengths.max(initial=1))):
        more = np.flatnonzero(lengths > i)
        out[more] |= raw[starts[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


class _Tokens:
    """Encodes whole texts with a byte-level model, words that come again from memory.

    The model's own pattern always ends a token before a space that a non-space
    follows, so texts are cut there and the parts are encoded alone.
    """

    def __init__(self, path: str, special_as_text: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = special_as_text
        vocabulary, special = self.model.get_vocab(), self.model.get_added_tokens_decoder()
        self.leads = {lead: np.zeros(max(vocabulary.values()) + 1, bool) for lead in LEADS}
        for lead, letter in LEADS.items():
            self.leads[lead][[i for x, i in vocabulary.items() if x.startswith(letter) and i not in special]] = True
        self.kind = "<u2" if max(vocabulary.values()) <= 0xFFFF else "<u4"  # holds any id
        # Word k has ids[ends[k] : ends[k + 1]]. Words stand for themselves with a space before them, but those
        # that start with a line break; a stop alone is written with a space, which no word starts with.
        self.known: dict[str, int] = {}
        self.ends, self.ids = np.zeros(1, np.int64), np.zeros(0, "<u4")
        self._keep([f" {x}" for x in STOPS], *self._encode(list(STOPS)))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        out: list[array] = []
        for a in range(0, len(texts), AT_ONCE):
            out += [array("I", e.ids) for e in self.model.encode_batch_fast(texts[a : a + AT_ONCE], add_special_tokens=False)]
        return np.frombuffer(b"".join(out), "<u4"), np.fromiter(map(len, out), np.int64, len(out))

    def _encode_joined(self, words: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """The same for words with ``lead`` before each of them, which none has within.

        A token ends before every lead, so many words are one text to the model; they are
        told apart by the tokens that start with the lead.
        """
        ids, _ = self._encode([lead + lead.join(words[a : a + JOINED]) for a in range(0, len(words), JOINED)])
        starts = np.flatnonzero(self.leads[lead][ids])
        if len(starts) != len(words):  # a special token took a lead with it
            return self._encode([lead + w for w in words])
        return ids, np.diff(starts, append=len(ids))

    @staticmethod
    def _parts(text: str) -> list[str]:
        """Parts after the first stand for themselves with a space before them."""
        parts = text.split(" ")
        if not _LOOSE.search(text):
            return parts
        out = parts[:1]
        for p in parts[1:]:
            if p and not p[0].isspace():
                out.append(p)
            else:
                out[-1] += f" {p}"
        return out

    @staticmethod
    def _atoms(part: str) -> list[str]:
        """What a part is made of: words, with the line break before them if there is one, and stops after them.

        A token also ends before and after a lone line break, and between a letter and
        a stop that a space or line break follows.
        """
        lines = part.split("\n")
        if len(lines) > 1 and not all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
            lines = [part]
        out = []
        for k, x in enumerate(lines):
            word = f"\n{x}" if k else x
            out += [word[:-1], f" {x[-1]}"] if x[-1] in STOPS and x[-2:-1].isalpha() else [word]
        return out

    def _keep(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Remember new words."""
        n, used = len(self.known), self.ends[len(self.known)]
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        self.ends, self.ids = _room(self.ends, n + len(words) + 1), _room(self.ids, used + len(ids))
        self.ends[n + 1 : n + len(words) + 1] = used + np.cumsum(lengths)
        self.ids[used : used + len(ids)] = ids

    def _remembered(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these words one after another, and how many each has."""
        starts = self.ends[which]
        lengths = self.ends[which + 1] - starts
        return self.ids[ragged(starts, lengths)], lengths

    def _learn(self, parts: list[str]) -> None:
        known, plain, made, atoms, counts = self.known, [], [], [], []
        for p in parts:
            found = self._atoms(p) if "\n" in p or p[-1] in STOPS else [p]
            if len(found) == 1:
                plain.append(p)
            else:
                made.append(p)
                atoms += found
                counts.append(len(found))
        spaced, broken, apart = [], [], []
        for w in dict.fromkeys(chain(plain, atoms)):
            if w not in known:
                (broken if w[0] == "\n" else apart if " " in w else spaced).append(w)
        self._keep(spaced, *self._encode_joined(spaced, " "))
        self._keep(broken, *self._encode_joined([w[1:] for w in broken], "\n"))
        self._keep(apart, *self._encode([f" {w}" for w in apart]))
        if made:
            ids, lengths = self._remembered(np.fromiter(map(known.__getitem__, atoms), np.int64, len(atoms)))
            self._keep(made, ids, np.add.reduceat(lengths, np.cumsum(counts) - counts))

    def flat(self, texts: list[str], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, ``end`` after each, and how many each text has.

        Texts are split and their parts numbered as arrays; only different parts are looked up.
        """
        if not texts:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if len(self.known) > REMEMBERED:  # the first words met are the most frequent ones
            self.known = dict(islice(self.known.items(), REMEMBERED // 2))
        column = pa.array(texts, pa.large_string())
        loose = np.flatnonzero(pc.match_substring_regex(column, _LOOSE_RE2).to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(column, " ")
        offsets, parts = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
        if len(loose):  # these few are split with care
            apart = [self._parts(texts[i]) for i in loose.tolist()]
            n = np.diff(offsets)
            n_apart = np.fromiter(map(len, apart), np.int64, len(apart))
            # all parts in order: those of loose texts are taken from behind
            begin = offsets[:-1].copy()
            begin[loose] = len(parts) + np.cumsum(n_apart) - n_apart
            n[loose] = n_apart
            both = pa.concat_arrays([parts, pa.array([x for y in apart for x in y], pa.large_string())])
            parts, offsets = both.take(pa.array(ragged(begin, n))), np.append(0, np.cumsum(n))
        first = np.zeros(len(parts), bool)
        first[offsets[:-1]] = True
        coded = parts.filter(pa.array(~first)).dictionary_encode()
        names, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        entries = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(entries < 0)
        unknown = [names[i] for i in new.tolist()]
        self._learn(unknown)
        entries[new] = np.fromiter(map(self.known.__getitem__, unknown), np.int64, len(unknown))
        last = np.frombuffer(end, "<u4")
        spelled, lengths = zip(self._remembered(entries), self._encode(parts.filter(pa.array(first)).to_pylist()), (last, [len(last)]), strict=True)
        spelled, lengths = np.concatenate(spelled), np.concatenate(lengths)
        # per text: its first part, the others, the end
        every = np.full(len(parts) + len(texts), len(lengths) - 1)
        place = np.arange(len(parts)) + np.repeat(np.arange(len(texts)), np.diff(offsets))
        every[place[first]] = len(names) + np.arange(len(texts))
        every[place[~first]] = which
        starts = np.cumsum(lengths) - lengths
        ids = spelled[ragged(starts[every], lengths[every])]
        return ids, np.add.reduceat(lengths[every], offsets[:-1] + np.arange(len(texts)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, 4 bytes each."""
        ids, counts = self.flat(texts)
        raw, stops = ids.tobytes(), np.cumsum(counts) * 4
        return [raw[b - 4 * n : b] for b, n in zip(stops.tolist(), counts.tolist(), strict=True)]


def _room(values: np.ndarray, n: int) -> np.ndarray:
    """The array with room for ``n`` values; it grows by doubling."""
    return values if n <= len(values) else np.append(values, np.zeros(max(n, 2 * len(values)) - len(values), values.dtype))


@cache
def _tokens(path: str, special_as_text: bool) -> _Tokens:
    """One per worker process, as tasks follow each other in it."""
    return _Tokens(path, special_as_text)


@cache
def _compressor() -> zstandard.ZstdCompressor:
    """One per worker process: making one costs more than most documents do."""
    return zstandard.ZstdCompressor(level=1)


def _zip(ids: np.ndarray, counts: np.ndarray, kind: str) -> list[bytes]:
    """Each text's ids as integers of one kind, compressed."""
    raw, cuts = ids.astype(kind).tobytes(), (np.cumsum(counts) * np.dtype(kind).itemsize).tolist()
    compress = _compressor().compress
    return [compress(raw[a:b]) for a, b in zip([0, *cuts], cuts, strict=False)]


@cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _unzip(packed: list[bytes], counts: np.ndarray) -> np.ndarray:
    """All ids of texts that ``_zip`` made one kind of, one text after another; there is one at least."""
    raw = b"".join(map(_decompressor().decompress, packed))
    return np.frombuffer(raw, f"<u{len(raw) // int(counts.sum())}")


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """A stored table: per document ``_id``, ``n`` and ``ids`` (compressed, the end id included), and
    per task a row of how often it met which ids (``met``)."""
    rows = texts_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, total = _tokens(tokenizer, special_as_text), array("I", [END]).tobytes(), np.zeros(0, np.int64)
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("_id"))
            for first, last, texts in chunks(batch, BLOCK_CHARS):
                ids, n = encode.flat(texts, end)
                count = np.bincount(ids, minlength=len(total))
                count[: len(total)] += total
                total = count
                yield pa.RecordBatch.from_arrays([keys.slice(first, last - first), pa.array(n, pa.int64()), pa.array(_zip(ids, n, encode.kind), pa.binary()), pa.nulls(last - first, _MET)], schema=out)
        met = np.flatnonzero(total)
        listed = pa.array([[{"id": int(a), "n": int(b)} for a, b in zip(met, total[met], strict=True)]], _MET)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), listed], schema=out)

    kind = to_arrow_type(rows.schema["_id"].dataType)
    out = pa.schema([("_id", kind), ("n", pa.int64()), ("ids", pa.binary()), ("met", _MET)])
    name = rows.schema["_id"].dataType.simpleString()
    return stage(rows.mapInArrow(run, f"_id {name}, n bigint, ids binary, met array<struct<id:bigint,n:bigint>>"), "token-ids")


_MET = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))


def frequency_ranks(table: DataFrame) -> np.ndarray:
    """All ids that ``encoded`` met, most frequent first, then by id."""
    counted = table.select(F.inline("met")).groupBy("id").agg(F.sum("n").alias("n"))
    return counted.orderBy(F.desc("n"), "id").select("id").toArrow().column(0).to_numpy().astype("<u4")


def write(
    docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, special_as_text: bool = False
) -> list[tuple[str, int]]:
    """Encode and write a corpus in ascending order of ``id_col``: paths of the shards in order and their numbers of ids.

    A null id comes first; rows of equal id are in an order of their ids. Null texts
    are empty, and an empty text has its end id only. An empty table makes no shard.
    Texts are encoded where they lie; their ids, compressed, travel once by range of
    document. Shards are as many as shuffle partitions unless ``shards`` says otherwise.
    """
    spark = docs.sparkSession
    table = encoded(docs, tokenizer, id_col, text_col, special_as_text)
    ranks = frequency_ranks(table)
    write_whole(f"{folder}/ranks.bin", [ranks.tobytes()])
    rank_of = np.zeros(int(ranks.max()) + 1 if len(ranks) else 1, "<u4")
    rank_of[ranks] = np.arange(len(ranks))
    sent = spark.sparkContext.broadcast(rank_of)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table.where("ids IS NOT NULL").select("_id", "n", "ids").repartitionByRange(shards, "_id").sortWithinPartitions("_id", "ids")

    def blocks(batches: Iterator[pa.RecordBatch], told: list[int]) -> Iterator[bytes]:
        for batch in batches:
            keys, n, ids = (batch.column(batch.schema.get_field_index(c)) for c in ("_id", "n", "ids"))
            n = n.to_numpy()
            ends, first = np.cumsum(n), 0
            while first < len(n):
                base = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, base + BLOCK_IDS, side="right")))
                part = ids.slice(first, last - first).to_pylist()
                values = sent.value[_unzip(part, n[first:last])]
                named = json.dumps(keys.slice(first, last - first).to_pylist()).encode()
                counts = n[first:last].astype("<u4").tobytes()
                control, data = pack(values)
                told[0] += len(values)
                told[1] += last - first
                yield struct.pack(HEAD, len(named), len(counts), len(control), len(data), len(values))
                yield from (named, counts, control, data)
                first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, told = TaskContext.get().partitionId(), [0, 0]
        path = f"{folder}/shard-{number:06d}.tids"
        write_whole(path, blocks(batches, told))
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([path]), pa.array([told[0]]), pa.array([told[1]])], ["number", "path", "n_ids", "n_docs"])

    made = rows.mapInArrow(run, "number bigint, path string, n_ids bigint, n_docs bigint").collect()
    return [(r.path, r.n_ids) for r in sorted(made, key=lambda r: r.number) if r.n_docs]


@cache
def _ranks(folder: str) -> np.ndarray:
    file = Ranges(f"{folder}/ranks.bin")
    return np.frombuffer(file(0, file.size), "<u4")


def read(spark: SparkSession, shards: list[tuple[str, int]], key_type: str = "bigint") -> DataFrame:
    """``key``, ``start`` (ids before the document), ``ids`` (4 bytes each, the end id included) from the files, in one task per shard."""
    starts = np.cumsum([0, *(n for _, n in shards)]).tolist()
    listed = spark.createDataFrame([(p, s) for (p, _), s in zip(shards, starts, strict=False)], "path string, start bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file, at, ranks = Ranges(path), 0, _ranks(path.rsplit("/", 1)[0])
                while at < file.size:
                    *lengths, n = struct.unpack(HEAD, file(at, struct.calcsize(HEAD)))
                    at += struct.calcsize(HEAD)
                    sections = []
                    for length in lengths:
                        sections.append(file(at, length))
                        at += length
                    keys, counts, control, data = sections
                    ids = ranks[unpack(control, data, n)].tobytes()
                    ends = np.cumsum(np.frombuffer(counts, "<u4").astype(np.int64))
                    begins = np.append(0, ends[:-1])
                    lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends * 4)), pa.py_buffer(ids)])
                    yield pa.RecordBatch.from_arrays([pa.array(json.loads(keys), _ARROW.get(key_type, pa.string())), pa.array(start + begins), lists.cast(pa.binary())], ["key", "start", "ids"])
                    start += n
                file.close()

    shuffled = listed.repartition(max(1, len(shards)), "start")
    return shuffled.mapInArrow(run, f"key {key_type}, start bigint, ids binary")


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
