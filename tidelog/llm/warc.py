"""WARC archives: a writer of deduplicated records and a salvage reader.

Writer: one gzip member for each record. Of records with one payload of at least MIN_DEDUP bytes that with the largest page_id
is a response, the others are revisits that name it; rows that share this largest id are all responses, a
row without page_id is a response. A null html is an empty payload, a null url gives no target URI.

Reader: takes whole archives (compressed by member, or plain). When a member or record fails its checks, it searches
for the next member that unpacks to a version line (or the next version line), goes on from there, and logs
the bytes between as a gap. An empty archive has neither records nor gaps.

Archives are written by Spark's text writer, which any Hadoop file system can take: a row is a member without its last byte, and the line
separator is that byte. The last byte of a member is the top byte of the unpacked length, 0 below 16 MiB; longer
records end with an empty member, whose length is 0.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, work_path

MIN_DEDUP = 1000
#: Bounds of an archive: aimed at in bytes of payload, never passed in bytes, most records.
ARCHIVE_BYTES, ARCHIVE_MOST, ARCHIVE_RECORDS = 32 << 20, 1 << 30, 20_000
VERSION = b"WARC/1.1"
GZIP = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r?\n")
_EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003") + b"\x03\x00" + bytes(8)


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of a record: HTTP header and payload, or for a revisit the header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    name = "none" if page_id is None else str(page_id)
    lines = [VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += ["WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], int, int, int] | str:
    """(header, start and end of the block, end of the record) of the record at a position, or what is wrong there."""
    version = _VERSION_LINE.match(data, at)
    if not version:
        return "no version line"
    start = data.find(b"\r\n\r\n", at)
    if start < 0:
        return "header without end"
    header = {}
    for line in data[version.end() : start].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return "broken header line"
        header[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d+", header.get("content-length", "")):
        return "no length"
    start += 4
    end = start + int(header["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return "no end of record where the length says"
    said = header.get("warc-block-digest", "")
    if said.startswith("sha1:") and base64.b32encode(hashlib.sha1(data[start:end]).digest()).decode() != said[5:]:
        return "block digest differs"
    return header, start, end, end + 4


def unpack(data: bytes, at: int, chunk: int = 1 << 16) -> tuple[bytes, int] | str:
    """(content, end) of the gzip member at a position, or what is wrong. Reads by chunks, so a file of many members takes linear time."""
    unpacker, out, pos = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof and pos < len(data):
            out.append(unpacker.decompress(data[pos : pos + chunk]))
            pos += chunk
    except zlib.error as e:
        return f"member: {e}"
    if not unpacker.eof:
        return "member without end"
    return b"".join(out), min(pos, len(data)) - len(unpacker.unused_data)


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", start, end, header, block) and ("gap", start, end, reason), which together cover all bytes."""
    at, size, gap, reason = 0, len(data), None, ""
    ahead = [-1, -1]
    while at < size:
        if data.startswith(GZIP, at):
            got = unpack(data, at)
            inner = got if isinstance(got, str) else None
            if not inner:
                content, end = got
                if content == b"":
                    inner = ""
                else:
                    read = parse(content)
                    inner = read if isinstance(read, str) else "more than a record in a member" if read[3] != len(content) else None
            if inner in (None, ""):
                if gap is not None:
                    yield "gap", gap, at, reason
                    gap = None
                if inner is None:
                    yield "record", at, end, read[0], content[read[1] : read[2]]
                at = end
                continue
            why = inner
        else:
            read = parse(data, at)
            if not isinstance(read, str):
                if gap is not None:
                    yield "gap", gap, at, reason
                    gap = None
                yield "record", at, read[3], read[0], data[read[1] : read[2]]
                at = read[3]
                continue
            why = read
        if gap is None:
            gap, reason = at, why
        for i, mark in enumerate((GZIP, b"WARC/")):
            if ahead[i] <= at:  # else the mark found before still lies ahead
                found = data.find(mark, at + 1)
                ahead[i] = found if found >= 0 else size
        at = min(ahead)
    if gap is not None:
        yield "gap", gap, size, reason


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes a record for each row (page_id, url, html) of pages into archives under path."""
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # Groups of equal payloads in few bytes a row; only those that have a revisit are kept and joined to the pages.
    dense = rows.select("page_id", "digest", F.octet_length("payload").cast("long").alias("n"))
    sizes = dense.agg(F.count("*").alias("rows"), F.sum("n").alias("bytes"), F.max("n").alias("most")).first()
    groups = dense.where((F.col("n") >= MIN_DEDUP) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("holder"), F.min("page_id").alias("first"))
    groups = stored(groups.where("first < holder").select("digest", "holder"), "warc-groups")
    rows = rows.join(groups, "digest", "left")
    rows = rows.withColumn("refers_to", F.when((F.octet_length("payload") >= MIN_DEDUP) & (F.col("page_id") < F.col("holder")), F.col("holder")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                out = []
                for page_id, url, data, digest, refers_to in zip(*(c.to_pylist() for c in part.columns)):
                    plain = record(page_id, url, data, digest, refers_to)
                    packed = member(plain)
                    out.append((packed if packed[-1] == 0 else packed + _EMPTY_MEMBER)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "member binary")
    records = max(1, min(ARCHIVE_RECORDS, ARCHIVE_BYTES * sizes["rows"] // max(1, sizes["bytes"] or 1), ARCHIVE_MOST // max(1, sizes["most"] or 1)))
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", records).text(path)


RECORDS = "kind string, file string, start long, end long, record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, reason string, block binary"


def read_archives(spark, path: str, blocks: bool = True) -> DataFrame:
    """Rows of kind record and gap from all archives under path. payload_bytes is the length that the HTTP header states, payload_digest
    bare lower-case hex. Records whose payload is at odds with its digest are logged as gaps."""

    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = {"start": pa.int64(), "end": pa.int64(), "payload_bytes": pa.int64(), "block": pa.binary()}

    def row(file: str, found: tuple) -> dict:
        base = dict.fromkeys(names) | {"kind": found[0], "file": file, "start": found[1], "end": found[2]}
        if found[0] == "gap":
            return base | {"reason": found[3]}
        header, block = found[3], found[4]
        digest = header.get("warc-payload-digest", "")
        digest = base64.b32decode(digest[5:]).hex() if re.fullmatch(r"sha1:[A-Z2-7]{32}", digest) else None
        http, _, payload = block.partition(b"\r\n\r\n")
        length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
        if header.get("warc-type") == "response" and digest and hashlib.sha1(payload).hexdigest() != digest:
            return base | {"kind": "gap", "reason": "payload digest differs"}
        return base | {"record_id": header.get("warc-record-id"), "record_type": header.get("warc-type"), "target_uri": header.get("warc-target-uri"), "payload_digest": digest, "payload_bytes": int(length[1]) if length else len(payload), "refers_to": header.get("warc-refers-to"), "block": block if blocks else None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for found in salvage(batch.column(1)[i].as_py()):
                    rows.append(row(batch.column(0)[i].as_py(), found))
                    held += len(rows[-1]["block"] or b"")
                    if len(rows) >= 1000 or held >= 8_000_000:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives in the shared folder, reads them back, and gives a row for each record."""
    path = work_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    found = read_archives(pages.sparkSession, path, blocks=False).where("kind = 'record'")
    number = lambda c: F.regexp_extract(c, r"(-?\d+)>$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c)).cast("long")
    return found.select(as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"))
