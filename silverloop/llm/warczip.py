"""WARC archives in ZIP packages: writing, and reading by range without extraction.

A package holds ``archive/data.warc.gz``, records each compressed on its own, and
``indexes/index.cdxj``, one JSON line per record with its place in that member. Both are
stored in the package uncompressed, so a record's place in the package is the
member's place plus its own. The reader looks for the end of central directory, follows
its ZIP64 forms where sizes or numbers need them, finds the members, and reads the index
and then each record by range.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverloop.llm.common import texts_of
from silverloop.llm.files import Ranges, write_whole

MIN_BYTES = 100
# Payload bytes of one package; a task writes as many as it needs.
PACKAGE_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MAX32, MAX16 = 0xFFFFFFFF, 0xFFFF

# Fixed values of the ZIP format: signatures and layouts.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_FORM, CENTRAL_FORM, END_FORM = "<4s5H3L2H", "<4s6H3L5H2L", "<4s4H2LH"
END64_FORM, LOCATOR64_FORM = "<4sQ2H2L4Q", "<4sLQL"


def package(members: list[tuple[str, list[bytes]]], zip64: bool = False) -> Iterator[bytes]:
    """A ZIP of stored members; ``zip64`` forces the long forms that large ones need."""
    at, listed = 0, []
    for name, parts in members:
        crc, size, label = 0, 0, name.encode()
        for part in parts:
            crc, size = zlib.crc32(part, crc), size + len(part)
        long = zip64 or size >= MAX32
        extra = struct.pack("<2H2Q", 1, 16, size, size) if long else b""
        short = MAX32 if long else size
        head = struct.pack(LOCAL_FORM, LOCAL, 45 if long else 20, 0x800, 0, 0, 33, crc, short, short, len(label), len(extra))
        yield head + label + extra
        listed.append((label, crc, size, at))
        at += len(head) + len(label) + len(extra) + size
        yield from parts
    start = at
    for label, crc, size, offset in listed:
        long = zip64 or size >= MAX32 or offset >= MAX32
        extra = struct.pack("<2H3Q", 1, 24, size, size, offset) if long else b""
        size, offset = (MAX32, MAX32) if long else (size, offset)
        entry = struct.pack(CENTRAL_FORM, CENTRAL, 45, 45 if long else 20, 0x800, 0, 0, 33, crc, size, size, len(label), len(extra), 0, 0, 0, 0, offset)
        yield entry + label + extra
        at += len(entry) + len(label) + len(extra)
    n, length = len(listed), at - start
    if zip64 or start >= MAX32 or n >= MAX16:
        yield struct.pack(END64_FORM, END64, 44, 45, 45, 0, 0, n, n, length, start)
        yield struct.pack(LOCATOR64_FORM, LOCATOR64, 0, at, 1)
        n, length, start = MAX16, MAX32, MAX32
    yield struct.pack(END_FORM, END, 0, 0, n, n, length, start, 0)


def members(read: Ranges) -> dict[str, tuple[int, int]]:
    """Place and size of the data of every stored member."""
    tail_at = max(0, read.size - 22 - MAX16)
    tail = read(tail_at, read.size - tail_at)
    at = tail.rfind(END)
    while at >= 0:  # the signature may also stand in a comment
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from(END_FORM, tail, at)[7] == len(tail):
            break
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    *_, n, length, start, _ = struct.unpack_from(END_FORM, tail, at)
    if MAX16 == n or MAX32 in (length, start):
        where = tail_at + at - struct.calcsize(LOCATOR64_FORM)
        if where >= 0:
            sign, _, end64, _ = struct.unpack(LOCATOR64_FORM, read(where, struct.calcsize(LOCATOR64_FORM)))
            if sign == LOCATOR64:
                sign, *_, n, length, start = struct.unpack(END64_FORM, read(end64, struct.calcsize(END64_FORM)))
                if sign != END64:
                    raise ValueError("no ZIP64 end of central directory")
    directory, out, at = read(start, length), {}, 0
    for _ in range(n):
        sign, _, _, _, method, _, _, _, packed, size, names, extras, comments, _, _, _, offset = struct.unpack_from(CENTRAL_FORM, directory, at)
        if sign != CENTRAL:
            raise ValueError("no central directory entry")
        at += struct.calcsize(CENTRAL_FORM)
        name, extra = directory[at : at + names].decode(), directory[at + names : at + names + extras]
        at += names + extras + comments
        while len(extra) >= 4:
            kind, width = struct.unpack_from("<2H", extra)
            if kind == 1:  # only the fields that didn't fit stand here, in this order
                long = list(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                size, packed, offset = (long.pop(0) if x == MAX32 and long else x for x in (size, packed, offset))
            extra = extra[4 + width :]
        if method == 0:
            sign, *_, names, extras = struct.unpack(LOCAL_FORM, read(offset, struct.calcsize(LOCAL_FORM)))
            if sign != LOCAL:
                raise ValueError(f"no member at {offset}")
            out[name] = offset + struct.calcsize(LOCAL_FORM) + names + extras, size
    return out


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) != size + 4:
        raise ValueError("a record's length is wrong")
    return headers, rest[:size]


def _uri(url: str | None) -> str:
    """A target on one line."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "urn:none")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> list[str]:
    """Write a record per row into packages in ``folder``; their paths.

    The payload is the page in UTF-8, null being empty. Of rows with equal payloads of
    at least ``min_bytes`` bytes the one with the smallest id is the response and the
    others, repeated rows of that id among them, revisit it; a null id is larger than
    any other. An empty table writes no package. Payloads are told equal by SHA-256;
    the smallest ids are found by a partial minimum, and a digest that many rows share
    is split by adaptive execution when they are joined.
    """
    rows = texts_of(pages, id_col, html_col, F.col(url_col).cast("string").alias("_url"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("_digest", F.sha2("_text", 256)).withColumn("_long", F.octet_length("_text") >= min_bytes)
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_row"))
    first = rows.where("_long").groupBy(F.col("_digest").alias("_d")).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    first = first.where("_n > 1").select("_d", F.col("_first")["_id"].alias("_to"), F.col("_first")["_row"].alias("_to_row"), F.lit(True).alias("_shared"))
    joined = rows.join(first, rows["_digest"] == first["_d"], "left")
    is_revisit = (F.col("_shared") & F.col("_long") & (F.col("_to_row") != F.col("_row"))).alias("_revisit")
    joined = joined.select("_id", "_url", "_text", "_digest", F.coalesce(is_revisit, F.lit(False)).alias("_revisit"), F.col("_to").cast("string").alias("_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, made = TaskContext.get().partitionId(), []
        records: list[bytes] = []
        index: list[bytes] = []
        held = at = 0

        def finish() -> None:
            nonlocal held, at
            if records:
                path = f"{folder}/pages-{number:06d}-{len(made):06d}.zip"
                write_whole(path, package([(ARCHIVE, records), (INDEX, index)]))
                made.append(path)
            records.clear()
            index.clear()
            held = at = 0

        for batch in batches:
            for key, url, text, digest, revisit, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = text.encode()
                name = json.dumps(key, default=str)
                kind = "revisit" if revisit else "response"
                headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{number}:{len(made)}:{len(index)}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url))]
                headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-Id", name), ("X-Payload-Length", str(len(payload)))]
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                if revisit:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", to or "null")]
                else:
                    http += payload
                packed = _record([*headers, ("Content-Type", "application/http; msgtype=response")], http)
                records.append(packed)
                index.append(json.dumps({"id": key, "offset": at, "length": len(packed), "type": kind}, default=str).encode() + b"\n")
                at += len(packed)
                held += len(packed)
                if held >= PACKAGE_BYTES:
                    finish()
        finish()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["path"])

    return sorted(r.path for r in joined.mapInArrow(run, "path string").collect())


def read(pages_spark, paths: list[str], id_type: str = "bigint") -> DataFrame:
    """A row per record of the packages: ``id``, ``url``, ``record_type``, ``refers_to``, ``payload_bytes``, ``payload_digest``, ``payload``.

    The payload of a revisit is null; its length and digest are those the record
    states. A response's are taken from what was read and must be those stated.
    """
    listed = pages_spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source = Ranges(path)
                found = members(source)
                base, _ = found[ARCHIVE]
                lines = source(*found[INDEX]).splitlines()
                for a in range(0, len(lines), 256):
                    rows = []
                    for line in lines[a : a + 256]:
                        entry = json.loads(line)
                        headers, block = _parsed(source(base + entry["offset"], entry["length"]))
                        payload = None
                        digest, size = headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["x-payload-length"])
                        if headers["warc-type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
                                raise ValueError(f"a payload in {path} isn't what its record states")
                        to = headers.get("x-refers-to-page-id", "null")
                        rows.append((headers["x-page-id"], headers["warc-target-uri"], headers["warc-type"], to, size, digest, payload))
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)
                source.close()

    out = listed.mapInArrow(run, "id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, payload binary")

    def typed(name: str):
        plain = F.when(F.col(name) != "null", F.regexp_replace(name, '^"|"$', "") if id_type == "string" else F.col(name))
        return plain.cast(id_type)

    return out.withColumns({"id": typed("id"), "refers_to": typed("refers_to")})


_TYPES = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
_NAMES = ["id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
