"""The byte format of a record, big-endian:

    body length u32 | offset u64 | timestamp i64 | key length i32 (-1: no key) | key | value length i32 | value | CRC-32 u32

The body length counts all between itself and the checksum; the checksum covers the body.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import MAX_BODY_BYTES

_FIXED = struct.Struct(">Qqi")


def _number(value: Column, digits: int) -> Column:
    return F.unhex(F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(digits)))


def record_bytes(offset: Column, timestamp_ms: Column, key: Column, value: Column) -> Column:
    """The record as binary, built of JVM functions only."""
    key_length = F.coalesce(F.octet_length(key), F.lit(-1))
    body = F.concat(_number(offset, 16), _number(timestamp_ms, 16), _number(key_length, 8), F.coalesce(key, F.lit(b"")), _number(F.octet_length(value), 8), value)
    return F.concat(_number(F.octet_length(body), 8), body, _number(F.crc32(body), 8))


def with_record(log: DataFrame) -> DataFrame:
    return log.withColumn("record", record_bytes(F.col("offset"), F.col("timestamp_ms"), F.col("key"), F.col("value")))


def encode(offset: int, timestamp_ms: int, key: bytes | None, value: bytes) -> bytes:
    body = _FIXED.pack(offset, timestamp_ms, -1 if key is None else len(key)) + (key or b"") + struct.pack(">i", len(value)) + value
    return struct.pack(">I", len(body)) + body + struct.pack(">I", zlib.crc32(body))


def decode(data: bytes, at: int = 0) -> tuple[int, int, bytes | None, bytes, int] | str:
    """(offset, timestamp, key, value, end), or what is wrong at the position."""
    if at + 4 > len(data):
        return "torn length"
    (size,) = struct.unpack_from(">I", data, at)
    if not 24 <= size <= MAX_BODY_BYTES:
        return "length out of range"
    end = at + 4 + size
    if end + 4 > len(data):
        return "torn record"
    body = data[at + 4 : end]
    if struct.unpack_from(">I", data, end)[0] != zlib.crc32(body):
        return "checksum differs"
    offset, timestamp, key_length = _FIXED.unpack_from(body)
    key_end = 20 + max(key_length, 0)
    if key_length < -1 or key_end + 4 > size:
        return "key length out of range"
    (value_length,) = struct.unpack_from(">i", body, key_end)
    if value_length < 0 or key_end + 4 + value_length != size:
        return "value length out of range"
    return offset, timestamp, None if key_length < 0 else body[20:key_end], body[key_end + 4 :], end + 4


def scan(data: bytes, failfast: bool = False) -> Iterator[tuple[int, int, bytes | None, bytes]]:
    """The valid records from the start of a segment. Recovery: what follows the first bad record isn't served; failfast raises instead."""
    at = 0
    while at < len(data):
        got = decode(data, at)
        if isinstance(got, str):
            if failfast:
                raise ValueError(f"byte {at}: {got}")
            return
        yield got[:4]
        at = got[4]
