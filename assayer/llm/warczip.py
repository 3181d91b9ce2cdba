"""WARC archives packed into ZIP files: writing, and reading by ranges without extraction.

A package is a ZIP file of stored (uncompressed) members: a WARC whose records are gzip members of
their own, and an index with the place of every record. The reader parses the end record, the
ZIP64 end record where there is one and the central directory, finds index and WARC inside the
package, and reads records by their ranges; nothing is unpacked to disk.

Packages are written by Spark's text sink, one to a file: the line end that the sink adds is the
one-byte comment at the end of the ZIP file. So they can go to any store that Spark writes to, and
a task that is run again leaves no half-written file. Reading goes through pyarrow's file systems.

A null payload counts as empty. Of records with equal payloads of at least ``SHARED`` bytes, the one
with the largest id is the response and the others revisit it; rows that repeat that id as well are
responses too, and so are rows of a group without any id. A null id comes back as null.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payload bytes from which equal payloads are stored once; payload bytes in a package; bytes that
#: a range read joins; parts into which the rows of one payload are dealt.
SHARED, PACKAGE, RANGE, SALTS = 1000, 8 << 20, 1 << 20, 32
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# Signatures and layouts of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
LOCAL_LAYOUT, CENTRAL_LAYOUT, END_LAYOUT = "<4s5H3I2H", "<4s6H3I5H2I", "<4s4H2IH"
END64_LAYOUT, LOCATOR64_LAYOUT = "<4sQ2H2I4Q", "<4sIQI"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF

Read = Callable[[int, int], bytes]


class Member(NamedTuple):
    name: str
    method: int
    crc: int
    packed: int
    size: int
    at: int  # of the local header


def pack(members: Iterable[tuple[str, bytes]], zip64: bool = False, comment: bytes = b"\n") -> bytes:
    """A ZIP file of stored members. ``zip64`` writes the large layout even where it isn't needed."""
    out, entries = bytearray(), []
    for name, data in members:
        raw, at, crc = name.encode(), len(out), zlib.crc32(data)
        large = zip64 or len(data) >= FULL32
        extra = struct.pack("<2H2Q", 1, 16, len(data), len(data)) if large else b""
        sizes = (FULL32, FULL32) if large else (len(data), len(data))
        out += struct.pack(LOCAL_LAYOUT, LOCAL, 45 if large else 20, 0x800, 0, 0, 33, crc, *sizes, len(raw), len(extra))
        out += raw + extra + data
        entries.append((raw, crc, len(data), at))
    start = len(out)
    for raw, crc, size, at in entries:
        large = zip64 or size >= FULL32 or at >= FULL32
        extra = struct.pack("<2H3Q", 1, 24, size, size, at) if large else b""
        sizes, place = ((FULL32, FULL32), FULL32) if large else ((size, size), at)
        out += struct.pack(
            CENTRAL_LAYOUT, CENTRAL, 45, 45 if large else 20, 0x800, 0, 0, 33, crc, *sizes, len(raw), len(extra), 0, 0, 0, 0, place
        )
        out += raw + extra
    length, large = len(out) - start, zip64 or len(out) >= FULL32 or len(entries) >= FULL16
    if large:
        at = len(out)
        out += struct.pack(END64_LAYOUT, END64, 44, 45, 45, 0, 0, len(entries), len(entries), length, start)
        out += struct.pack(LOCATOR64_LAYOUT, LOCATOR64, 0, at, 1)
    few = (FULL16, FULL16, FULL32, FULL32) if large else (len(entries), len(entries), length, start)
    out += struct.pack(END_LAYOUT, END, 0, 0, *few, len(comment)) + comment
    return bytes(out)


def members(read: Read, size: int) -> dict[str, Member]:
    """Parse the directories at the end of a ZIP file of ``size`` bytes."""
    tail_at = max(0, size - struct.calcsize(END_LAYOUT) - FULL16 - struct.calcsize(LOCATOR64_LAYOUT))
    tail = read(tail_at, size - tail_at)
    at = len(tail)
    while (at := tail.rfind(END, 0, at)) >= 0:
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break  # its comment ends the file, so this is no signature inside a comment
    if at < 0:
        raise ValueError("no end record: this is no ZIP file")
    *_, count, length, start, _ = struct.unpack_from(END_LAYOUT, tail, at)
    locator = at - struct.calcsize(LOCATOR64_LAYOUT)
    if locator >= 0 and tail[locator : locator + 4] == LOCATOR64:
        _, _, far, _ = struct.unpack_from(LOCATOR64_LAYOUT, tail, locator)
        record = struct.unpack(END64_LAYOUT, read(far, struct.calcsize(END64_LAYOUT)))
        if record[0] != END64:
            raise ValueError("the ZIP64 locator points at no ZIP64 end record")
        count, length, start = record[7], record[8], record[9]
    directory, found, at = read(start, length), {}, 0
    for _ in range(count):
        head = struct.unpack_from(CENTRAL_LAYOUT, directory, at)
        if head[0] != CENTRAL:
            raise ValueError("broken central directory")
        (method, crc, packed, full), (names, extras, comments) = (head[4], *head[7:10]), head[10:13]
        place, at = head[16], at + struct.calcsize(CENTRAL_LAYOUT)
        name, extra = directory[at : at + names], directory[at + names : at + names + extras]
        while len(extra) >= 4:
            kind, span = struct.unpack_from("<2H", extra)
            if kind == 1:  # only what does not fit above stands here, in this order
                wide = list(struct.unpack_from(f"<{span // 8}Q", extra, 4))
                full = wide.pop(0) if full == FULL32 else full
                packed = wide.pop(0) if packed == FULL32 else packed
                place = wide.pop(0) if place == FULL32 else place
            extra = extra[4 + span :]
        member = Member(name.decode("utf-8" if head[3] & 0x800 else "cp437"), method, crc, packed, full, place)
        found[member.name] = member
        at += names + extras + comments
    return found


def stored_at(read: Read, member: Member) -> int:
    """Where the bytes of a stored member begin; the local header has lengths of its own."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed, so its records have no ranges")
    head = struct.unpack(LOCAL_LAYOUT, read(member.at, struct.calcsize(LOCAL_LAYOUT)))
    if head[0] != LOCAL:
        raise ValueError(f"no local header of {member.name}")
    return member.at + struct.calcsize(LOCAL_LAYOUT) + head[9] + head[10]


def urn(page: str | None) -> str:
    return f"<urn:page:{page or ''}>"


def page_of(name: str | None) -> str | None:
    return (name or "")[len("<urn:page:") : -1] or None


def record(row: dict, date: str) -> bytes:
    """A gzip member with one WARC record. A revisit has no body; its digest and length are those of the full payload."""
    payload, revisit = (row["payload"] or "").encode("utf-8", "replace"), row["record_type"] == "revisit"
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    fields = {
        "WARC-Type": row["record_type"], "WARC-Record-ID": urn(row["page_id"]), "WARC-Date": date,
        "WARC-Target-URI": re.sub(r"[\r\n]+", " ", row["url"] or ""), "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Payload-Length": str(len(payload)), "Content-Type": "text/html",
    }
    if revisit:
        fields |= {
            "WARC-Refers-To": urn(row["refers_to"]),
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        }
    body = b"" if revisit else payload
    head = "".join(f"{k}: {v}\r\n" for k, v in (fields | {"Content-Length": str(len(body))}).items())
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(f"WARC/1.1\r\n{head}\r\n".encode() + body + b"\r\n\r\n") + squeeze.flush()


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and body of a record."""
    whole = zlib.decompress(raw, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record at this range")
    fields = dict(x.split(": ", 1) for x in lines)
    return fields, rest[: int(fields["Content-Length"])]


def package(rows: list[dict], date: str) -> bytes:
    data, index = bytearray(), []
    for row in rows:
        made = record(row, date)
        place = {"offset": len(data), "length": len(made), "page": row["page_id"], "type": row["record_type"]}
        index.append(f"{len(index):010d} {json.dumps(place)}\n")
        data += made
    return pack([(WARC, bytes(data)), (INDEX, "".join(index).encode())])


def with_types(pages: DataFrame, key: str = "page_id", text: str = "html", url: str = "url") -> DataFrame:
    """``page_id`` (text), ``url``, ``payload``, its digest and length, ``record_type`` and ``refers_to``.

    Payloads that occur once take no part in the join. The rows of a repeated one are dealt over
    ``SALTS`` keys, so that a payload of a third of all rows is no single task.
    """
    payload = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = pages.select(
        F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload"),
        F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    shared = (
        own.where(F.col("payload_bytes") >= SHARED).groupBy("payload_digest")
        .agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("rows"))
        .where("rows > 1 and response is not null")
        .select("payload_digest", "response", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    dealt = own.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    revisit = F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response"))
    return dealt.join(shared, ["payload_digest", "salt"], "left").select(
        F.col("id").cast("string").alias("page_id"), "url", "payload", "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("response").cast("string")).alias("refers_to"),
    )


def write_packages(typed: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the records of ``with_types`` as packages of about ``PACKAGE`` payload bytes each."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def out() -> pa.RecordBatch:
            whole = package(rows, date)[:-1]  # the sink puts the last byte, the line end
            return pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], names=["value"])

        for batch in batches:
            for row in batch.to_pylist():
                rows.append(row)
                size += row["payload_bytes"]
                if size >= PACKAGE:
                    yield out()
                    rows, size = [], 0
        if rows:
            yield out()

    built = typed.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    built.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def opened(path: str):
    """A file for range reads, from any store pyarrow knows."""
    store, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return store.open_input_file(name)


def records(read: Read, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of a package by its index; neighbours are read in ranges of about ``RANGE`` bytes."""
    listed = members(read, size)
    index, start = listed[INDEX], stored_at(read, listed[WARC])
    lines = read(stored_at(read, index), index.size).decode().splitlines()
    places = [(x["offset"], x["length"]) for x in (json.loads(line.split(" ", 1)[1]) for line in lines)]
    while places:
        first, take = places[0][0], 1
        while take < len(places) and places[take][0] + places[take][1] - first <= RANGE:
            take += 1
        block = read(start + first, places[take - 1][0] + places[take - 1][1] - first)
        for at, length in places[:take]:
            yield parsed(block[at - first : at - first + length])
        places = places[take:]


def read_packages(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of all packages below ``path``; the digest of every body is checked."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, held = [], 0
                with opened(row["path"]) as f:

                    def read(at: int, length: int, f=f) -> bytes:
                        f.seek(at)
                        return f.read(length)

                    for fields, body in records(read, row["length"]):
                        digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                        kind = fields["WARC-Type"]
                        if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"wrong digest in {row['path']}: {fields['WARC-Record-ID']}")
                        rows.append(
                            (
                                page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"],
                                int(fields["WARC-Payload-Length"]), digest, kind,
                                page_of(fields.get("WARC-Refers-To")),
                                body.decode("utf-8", "replace") if payload and kind == "response" else None,
                            )
                        )
                        held += len(body)
                        if len(rows) >= 2000 or payload and held >= RANGE:
                            yield _batch(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload string"
    return files.mapInArrow(scan, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
