"""Scalar functions of the log as Spark columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import NAME_PATTERN

RECORD_OVERHEAD = 32
# FNV-1a, 64 bits: offset basis 14695981039346656037 in two halves, prime 2^40 + 435.
_BASIS_HIGH, _BASIS_LOW, _PRIME_LOW, _MASK = 3421674724, 2216829733, 435, 0xFFFFFFFF


def fnv1a64(data: Column) -> Column:
    """The unsigned hash of a string's or binary's bytes as struct (hi, lo) of 32 bits each. BIGINT can't hold it, and
    ANSI arithmetic must not overflow. Null stays null."""
    raw = data.cast("binary")
    # One pass cuts the bytes into characters of Latin-1, whose code is the byte.
    places = F.when(F.octet_length(raw) > 0, F.split(F.decode(raw, "ISO-8859-1"), "")).otherwise(F.array().cast("array<string>"))
    start = F.struct(F.lit(_BASIS_HIGH).cast("long").alias("hi"), F.lit(_BASIS_LOW).cast("long").alias("lo"))

    def step(h: Column, character: Column) -> Column:
        x = h["lo"].bitwiseXOR(F.ascii(character).cast("long"))
        low = x * _PRIME_LOW
        high = h["hi"] * _PRIME_LOW + F.shiftrightunsigned(low, 32) + F.shiftleft(x.bitwiseAND(0xFFFFFF), 8)
        return F.struct(high.bitwiseAND(_MASK).alias("hi"), low.bitwiseAND(_MASK).alias("lo"))

    return F.when(raw.isNotNull(), F.aggregate(places, start, step))


def unsigned_mod(hash_: Column, n: Column) -> Column:
    n = n.cast("long")
    return F.pmod(F.pmod(hash_["hi"], n) * F.pmod(F.lit(1 << 32), n) + F.pmod(hash_["lo"], n), n).cast("int")


def key_partition(key: Column, n: Column) -> Column:
    return unsigned_mod(fnv1a64(key), n)


def payload_bytes(key: Column, value: Column) -> Column:
    return (F.coalesce(F.octet_length(key), F.lit(0)) + F.octet_length(value)).cast("long")


def disk_size(key: Column, value: Column) -> Column:
    return payload_bytes(key, value) + RECORD_OVERHEAD


def segment_file(base: Column) -> Column:
    return F.lpad(base.cast("string"), 20, "0")


def is_tombstone(value: Column) -> Column:
    return F.octet_length(value) == 0


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0).cast("long"))


def ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b).cast("int")


def prefix_match(prefix: Column, name: Column) -> Column:
    """A grant's prefix covers a name: * covers all, empty none; else the name starts with it and ends there, or the prefix ends in a
    separator, or a dot follows."""
    after = F.substring(name, F.length(prefix) + 1, F.lit(1))
    edge = (F.length(name) == F.length(prefix)) | F.right(prefix, F.lit(1)).isin(".", "-", "_") | (after == ".")
    return F.when(prefix == "*", F.lit(True)).when(prefix == "", F.lit(False)).otherwise(name.startswith(prefix) & edge)


def subject_topic(subject: Column) -> Column:
    """The topic of a schema subject: one suffix -value or -key goes if something is left."""
    return F.regexp_replace(subject, "(?s)^(.+)-(value|key)$", "$1")


def valid_name(name: Column) -> Column:
    return F.coalesce(name.rlike(NAME_PATTERN) & ~name.isin(".", ".."), F.lit(False))


def valid_id(name: Column) -> Column:
    return F.coalesce(name.rlike(NAME_PATTERN), F.lit(False))


def as_text(value: Column) -> Column:
    """Text of bytes; invalid UTF-8 is replaced."""
    return F.make_valid_utf8(value.cast("string"))


def encoded(value: Column, encoding: str | None = None) -> Column:
    if encoding is None:
        return as_text(value)
    if encoding != "base64":
        raise ValueError(f"unsupported encoding {encoding}")
    return F.base64(value.cast("binary"))


def label_escape(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def secret_hash(secret: Column) -> Column:
    return F.sha2(secret.cast("binary"), 256)


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970, floored, of a timestamp with or without zone (UTC session)."""
    return F.unix_millis(ts.cast("timestamp"))


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())
