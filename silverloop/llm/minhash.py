"""MinHash near-duplicates: one-permutation hashing, banded buckets, stars, confirmed links.

A document's set holds its distinct word shingles. One hash per shingle deals the set to
bins, and the smallest hash of a bin is its value (one permutation for all bins). An
empty bin takes the value of the first bin that is not empty in an order of its own
(optimal densification: any of them is as likely, whatever its neighbours). Bins are
taken in bands; documents with an equal band share a bucket.

Documents of equal sets are one node, so exact copies never meet. A bucket proposes a
star: its centre against each other member, which is linear in the bucket. The links
proposed are confirmed on the full sets. Where a bucket still holds several classes
after that, all members of a small bucket, and four of a larger one, are centres of
further stars to the other classes, then the next four and so on, until all were or a
round confirms no link. So a round is linear in large buckets, and small ones are compared
whole.

What the rounds leave of larger buckets is then compared whole too, block by block: each
member against every one of another class, by odd sketches. Bit i of a sketch is the
parity of the shingles that fall on it, so two sets differ in at least as many shingles as
their sketches in bits, and a pair whose sketches differ in more bits than linked sets do
is no link for certain. All others are confirmed on full sets. So every two members of a
bucket are in one class, or known to be no link.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverloop.llm.common import chunks, stage, texts_of
from silverloop.llm.simhash import components

SHINGLE = 3
# Links have 100 * shared >= PERCENT * united shingles.
PERCENT = 85
# Two sets of similarity 0.85 share no band with a chance of (1 - 0.85 ** 6) ** 32: 3 in ten millions.
BANDS, ROWS = 32, 6
# In a bucket of this size or less every member is a centre at once; in a larger one, so many in each round.
WHOLE, CENTRES = 16, 4
# Members of a block of a larger bucket; two blocks meet in one task. Bits of an odd sketch (a power of two).
SIDE, SKETCH = 512, 2048
# Pairs of sketches that a task compares at once.
AT_ONCE = 1 << 15
# Rows of two digests that may be broadcast.
BROADCAST_ROWS = 1_000_000
# Bytes of one text that are split into words at once.
BLOCK = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text, A-Z in lower case; a long text goes block by block."""
    raw, at, out = text.encode(), 0, []
    while at < len(raw):
        end = len(raw)
        if at + BLOCK < end:
            gap = _GAP.search(raw, at + BLOCK)
            end = gap.start() if gap else end
        words = raw[at:end].lower().split()
        out.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Distinct shingles of a text as ascending 64-bit hashes; fewer words than a shingle are one as a whole."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(shingle, len(words))
    hashed = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        hashed = _mix(hashed * _ODD + words[k : len(words) - size + 1 + k])
    return np.unique(hashed)


@cache
def _orders(bins: int) -> np.ndarray:
    """Row i: the place of every bin in the order in which the empty bin i looks for a value."""
    keys = np.arange(bins * bins, dtype=np.uint64).reshape(bins, bins)
    return np.argsort(np.argsort(_mix(keys * _ODD + np.uint64(1)), axis=1), axis=1).astype(np.int32)


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """A value per bin of a set that is not empty, given as ascending hashes."""
    dealt = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)  # ascending, as the hashes are
    first = np.flatnonzero(np.append(True, dealt[1:] != dealt[:-1]))
    full = dealt[first].astype(np.int64)
    values = np.empty(bins, np.uint64)
    values[full] = hashes[first]
    if len(full) < bins:
        empty = np.setdiff1d(np.arange(bins), full, assume_unique=True)
        donors = full[np.argmin(_orders(bins)[np.ix_(empty, full)], axis=1)]
        values[empty] = values[donors]
    return values


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key per band of every signature; keys of different bands differ."""
    split = signatures.reshape(len(signatures), bands, signatures.shape[1] // bands)
    keys = np.tile(_mix(np.arange(1, bands + 1, dtype=np.uint64) * _ODD), (len(signatures), 1))
    for k in range(split.shape[2]):
        keys = _mix(keys * _ODD + split[:, :, k])
    return keys


def odd_sketch(hashes: np.ndarray) -> bytes:
    """A bit per slot of a set: whether an odd number of its hashes falls there."""
    slots = (hashes >> np.uint64(65 - SKETCH.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=SKETCH) & 1).astype(bool)).tobytes()


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``_id``, ``_t`` (digest of the text), ``key`` (digest of the set), ``n`` (its size) and ``bands`` of every row.

    A text without words, null or empty, has no shingles: ``n`` is 0, ``key`` and ``bands`` are null.
    """
    texts = texts_of(docs, id_col, text_col).select("_id", F.unhex(F.md5("_text")).alias("_t"), "_text")
    kind = texts.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, part in chunks(batch):
                sets = [shingle_set(t, shingle) for t in part]
                some = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(np.array([signature(sets[i], bands * rows) for i in some], np.uint64).reshape(len(some), bands * rows), bands)
                buckets: list = [None] * len(sets)
                for i, k in zip(some, keys.view(np.int64), strict=True):
                    buckets[i] = k
                digests = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
                n = [len(s) for s in sets]
                here = batch.slice(first, last - first).select(["_id", "_t"])
                yield pa.RecordBatch.from_arrays([*here.columns, pa.array(digests, pa.binary()), pa.array(n, pa.int64()), pa.array(buckets, pa.list_(pa.int64()))], ["_id", "_t", "key", "n", "bands"])

    return texts.mapInArrow(run, f"_id {kind}, _t binary, key binary, n bigint, bands array<bigint>")


def _members(nodes: DataFrame) -> DataFrame:
    """``bucket``, ``size``, ``key``, ``n`` of the nodes in buckets of several.

    Buckets are counted with partial sums before their members are looked up, so neither
    step holds a bucket.
    """
    dealt = nodes.select("key", "n", F.explode("bands").alias("bucket"))
    several = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return dealt.join(several, "bucket")


def _sent(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it has few rows of a fixed width; joined by a shuffle beyond that."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _fitting(pairs: DataFrame, percent: int) -> DataFrame:
    """``u``, ``v`` of ``c`` and ``key`` whose set sizes allow a link, each pair once."""
    fits = (F.col("c") != F.col("key")) & (100 * F.least("c_n", "n") >= percent * F.greatest("c_n", "n"))
    return pairs.where(fits).select(F.least("c", "key").alias("u"), F.greatest("c", "key").alias("v")).distinct()


def _first_stars(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of each bucket's centre with its other members. The centre is the member that shares
    the most buckets with others, as the text that the others are copies of does."""
    shared = members.groupBy("key").agg(F.sum("size").alias("shared"))
    known = members.join(shared, "key")
    centre = F.max(F.struct("shared", "key", "n")).alias("m")
    stars = known.groupBy("bucket").agg(centre).select("bucket", F.col("m.key").alias("c"), F.col("m.n").alias("c_n"))
    return _fitting(members.join(stars, "bucket"), percent)


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with their class, ``root``, in buckets that hold several classes."""
    classed = members.join(roots, F.col("key") == F.col("node"), "left").select("bucket", "size", "key", "n", F.coalesce("root", "key").alias("root"))
    mixed = classed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    return classed.join(mixed, "bucket")


def _more_stars(members: DataFrame, roots: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs across classes in buckets that hold several: all of a small one; the next ``CENTRES`` members or so
    of a larger one, in an order that buckets share, against its members of other classes."""
    open_ = _open(members, roots)
    place = F.shiftrightunsigned(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) * F.col("size"), 20)
    chosen = open_.where((F.col("size") <= WHOLE) | ((place >= CENTRES * (turn - 1)) & (place < CENTRES * turn)))
    stars = chosen.select("bucket", F.col("key").alias("c"), F.col("n").alias("c_n"), F.col("root").alias("c_root"))
    return _fitting(open_.join(stars, "bucket").where("root <> c_root"), percent)


def _sketched(texts: DataFrame, shingle: int) -> DataFrame:
    """``key`` and ``sketch`` of candidates' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, part in chunks(batch):
                made = pa.array([odd_sketch(shingle_set(t, shingle)) for t in part], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), made], ["key", "sketch"])

    return texts.select("key", "_text").mapInArrow(run, "key binary, sketch binary")


def _cells(open_: DataFrame, side: int) -> DataFrame:
    """Members of large buckets dealt to cells ``bucket``, ``i``, ``j``, where all that must meet do.

    Most members are often of one class, and they need not meet: they are ``inner`` blocks,
    and meet the blocks of the others only, which meet each other as well. ``left`` and
    ``right`` say which side of its cell a row is on.
    """
    held = open_.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("held")).groupBy("bucket")
    sizes = held.agg(F.max(F.struct("held", "root")).alias("m"), F.sum("held").alias("all"))
    blocks = lambda rows: F.ceil(rows / side).cast("long")
    sizes = sizes.select("bucket", F.col("m.root").alias("most"), blocks(F.col("m.held")).alias("inner"), blocks(F.col("all") - F.col("m.held")).alias("outer"))
    dealt = open_.join(sizes, "bucket").withColumn("is_inner", F.col("root") == F.col("most"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("key", "bucket"), F.when(F.col("is_inner"), F.col("inner")).otherwise(F.col("outer"))))
    cell = lambda i, j, left, right: F.struct(i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    yes, no, block = F.lit(True), F.lit(False), F.col("block")
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # cells of two outer blocks have i <= j; those of an outer and an inner one have j below zero
    of_inner = F.transform(every(F.col("outer")), lambda o: cell(o, -1 - block, no, yes))
    to_inner = F.transform(every(F.col("inner")), lambda o: cell(block, -1 - o, yes, no))
    to_outer = F.transform(every(F.col("outer")), lambda o: cell(F.least(block, o), F.greatest(block, o), block <= o, block >= o))
    at = F.explode(F.when(F.col("is_inner"), of_inner).otherwise(F.concat(to_inner, to_outer)))
    return dealt.select("bucket", "key", "n", "root", at.alias("at")).select("bucket", "key", "n", "root", "at.*")


def _rest(members: DataFrame, roots: DataFrame, texts: DataFrame, shingle: int, percent: int, side: int = SIDE) -> DataFrame:
    """``u``, ``v`` of all pairs across classes in larger buckets that sizes and sketches allow to be links."""
    open_ = stage(_open(members.where(F.col("size") > WHOLE), roots), "minhash-open")
    sketches = stage(_sketched(texts.join(open_.select("key").distinct(), "key"), shingle), "minhash-sketches")
    cells = _cells(open_, side).join(sketches, "key")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        left, right = (np.flatnonzero(table.column(c).to_numpy()) for c in ("left", "right"))
        n, keys = table.column("n").to_numpy(), table.column("key").to_pylist()
        classes_ = np.unique(np.array([r.hex() for r in table.column("root").to_pylist()]), return_inverse=True)[1]
        words = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(keys), SKETCH // 64)
        us, vs = [], []
        step = max(1, AT_ONCE // max(1, len(right)))
        for k in range(0, len(left), step):
            rows = left[k : k + step]
            a, b = np.repeat(rows, len(right)), np.tile(right, len(rows))
            fits = (classes_[a] != classes_[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
            a, b = a[fits], b[fits]
            differ = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)
            # 100 * shared >= percent * united, in terms of the sizes and the number of shingles that differ
            near = (100 + percent) * differ <= (100 - percent) * (n[a] + n[b])
            for x, y in zip(a[near], b[near], strict=True):
                us.append(min(keys[x], keys[y]))
                vs.append(max(keys[x], keys[y]))
        return pa.table({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})

    return cells.groupBy("bucket", "i", "j").applyInArrow(compare, "u binary, v binary").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose full sets are that similar. Each side's text goes to its pair, so a centre of many pairs is no hot key."""
    sent = _sent(pairs)
    first = texts.join(sent, texts.key == F.col("u")).select("u", "v", F.col("_text").alias("_a"))
    second = texts.join(sent, texts.key == F.col("v")).select("u", "v", F.col("_text").alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, left = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            u, a, b = (batch.column(batch.schema.get_field_index(c)) for c in ("u", "_a", "_b"))
            for i in range(batch.num_rows):
                if u[i].as_py() != known:  # pairs of one text may follow each other
                    known, left = u[i].as_py(), shingle_set(a[i].as_py(), shingle)
                right = shingle_set(b[i].as_py(), shingle)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return first.join(second, ["u", "v"]).select("u", "v", "_a", "_b").mapInArrow(run, "u binary, v binary")


def links(nodes: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``node``, ``root`` of every node that is linked: links found by stars and confirmed on full sets.

    ``nodes`` has ``key``, ``n``, ``_t`` and ``bands`` of every distinct set, ``texts`` has ``_t``
    and ``_text``; texts repeat as they like. Both may be empty, and then so is the result.
    """
    members = stage(_members(nodes), "minhash-members")
    wanted = stage(nodes.join(members.select("key").distinct(), "key").select("key", "_t"), "minhash-wanted")
    kept = stage(texts.join(_sent(wanted), "_t").dropDuplicates(["key"]).select("key", "_text"), "minhash-texts")
    roots = nodes.sparkSession.createDataFrame([], "node binary, root binary")
    pairs = stage(_first_stars(members, percent), "minhash-pairs")
    tested, found = pairs, None
    largest = members.agg(F.max("size")).first()[0] or 0
    for turn in count(1):
        new = stage(_confirmed(pairs, kept, shingle, percent), "minhash-confirmed")
        if not new.isEmpty():
            found = new if found is None else found.unionByName(new)
            roots = stage(components(found, "minhash-links"), "minhash-roots")
        if turn > 1 and (new.isEmpty() or largest <= WHOLE or CENTRES * (turn - 1) >= largest):
            break
        pairs = stage(_more_stars(members, roots, turn, percent).join(tested, ["u", "v"], "left_anti"), "minhash-pairs")
        tested = tested.unionByName(pairs)
    if largest > WHOLE:
        rest = _rest(members, roots, kept, shingle, percent).join(tested, ["u", "v"], "left_anti")
        new = stage(_confirmed(stage(rest, "minhash-pairs"), kept, shingle, percent), "minhash-confirmed")
        if not new.isEmpty():
            roots = stage(components(new if found is None else found.unionByName(new), "minhash-links"), "minhash-roots")
    return roots


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` (smallest id reachable, itself included) of every row.

    Texts without words are linked with nothing: their component is their own id.
    Repeated rows give repeated rows of one class. A null id is larger than any other; a
    class of null ids only has a null ``component_id``. An empty table gives an empty result.
    """
    marked = stage(signed(docs, id_col, text_col, shingle, bands, rows), "minhash")
    some = marked.where("n > 0").groupBy("key").agg(F.min("_t").alias("_t"), F.min("n").alias("n"), F.any_value("bands").alias("bands"))
    texts = docs.select(F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("_t"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    roots = links(stage(some, "minhash-nodes"), texts, shingle, percent)
    lows = marked.where("n > 0").groupBy("key").agg(F.min("_id").alias("low"))
    rooted = lows.join(roots, F.col("key") == F.col("node"), "left").select("key", "low", F.coalesce("root", "key").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of_set = rooted.join(lowest, "root").select("key", "component_id")
    placed = marked.select("_id", "key", "n").join(of_set, "key", "left")
    own = F.when(F.col("n") == 0, F.col("_id")).otherwise(F.col("component_id"))
    return placed.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))
