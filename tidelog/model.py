"""Schemas, limits and name rules of event logs."""

from __future__ import annotations

import re

LOG_SCHEMA = "topic string, partition int, offset bigint, timestamp_ms bigint, key binary, value binary"
COMMIT_SCHEMA = "`group` string, topic string, partition int, offset bigint, commit_seq bigint"
PRODUCER_STATE = "producer_id string, topic string, partition int, last_seen bigint, last_offset bigint, recent array<struct<seq:bigint,offset:bigint>>, last_used_ms bigint"
TOPIC_CATALOG = "name string, partitions int, retention_ms bigint, retention_bytes bigint, cleanup_policy string, segment_bytes bigint, tombstone_retention_ms bigint"
SCHEMA_REGISTRY = "id int, subject string, type string, schema string, created_at_ms bigint"
API_KEYS = "key_id string, name string, secret_sha256 string, acls array<struct<action:string,topic_prefix:string>>, produce_bps int, consume_bps int, created_at_ms bigint, disabled boolean"

# Fixed values of the log format and its rules.
MAX_PARTITIONS = 10_000
NAME_PATTERN = r"^[A-Za-z0-9_.-]{1,200}$"
SEGMENT_BYTES_MIN, SEGMENT_BYTES_MAX, SEGMENT_BYTES_DEFAULT = 128, 1 << 40, 64 << 20
MAX_RECORD_BYTES = 8 << 20
MAX_BODY_BYTES = 256 << 20
MAX_PRODUCE_RECORDS = 100_000
FETCH_RECORDS_DEFAULT, FETCH_BYTES_DEFAULT, FETCH_RECORDS_MAX, FETCH_BYTES_MAX = 100, 1 << 20, 10_000, 8 << 20
MAX_GROUPS = MAX_GROUP_ENTRIES = 100_000
MAX_MEMBERS, MAX_MEMBER_TOPICS = 1_000, 100
MAX_KEY_GRANTS = 100
MAX_PRODUCERS, MAX_PRODUCERS_PER_KEY, PRODUCER_IDLE_MS, PRODUCER_WINDOW = 100_000, 10_000, 7 * 86_400_000, 128
MAX_SCHEMAS, MAX_SCHEMA_BYTES = 100_000, 512 << 10
MEMBER_TIMEOUT_MS = 15_000
TOMBSTONE_RETENTION_MS = 86_400_000
INDEX_INTERVAL_BYTES = 4096
CLEANUP_POLICIES = ("delete", "compact", "compact,delete")
DEFAULT_CONFIG = {"retention_ms": None, "retention_bytes": None, "cleanup_policy": "delete", "segment_bytes": SEGMENT_BYTES_DEFAULT, "tombstone_retention_ms": TOMBSTONE_RETENTION_MS}


class LogError(ValueError):
    """A refused request, with the status an API would answer."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


# Units of durations and their nanoseconds; a month has 30.44 days and a year 365.25. M is a month, m a minute.
DURATION_UNITS = {
    "nsec ns": 1,
    "usec us": 1_000,
    "msec ms": 1_000_000,
    "seconds second sec s": 1_000_000_000,
    "minutes minute min m": 60_000_000_000,
    "hours hour hr h": 3_600_000_000_000,
    "days day d": 86_400_000_000_000,
    "weeks week w": 604_800_000_000_000,
    "months month M": 2_630_016_000_000_000,
    "years year y": 31_557_600_000_000_000,
}
_NANOS = {name: nanos for names, nanos in DURATION_UNITS.items() for name in names.split()}


def duration_ms(text: str) -> int:
    """Whole milliseconds of a duration such as 7d, 1h 30m or 500ms: numbers with a unit each, added up. A bare 0 needs no unit."""
    if text.strip() == "0":
        return 0
    parts = re.findall(r"([0-9]+)\s*([A-Za-z]+)", text)
    if not re.fullmatch(r"(?:\s*[0-9]+\s*[A-Za-z]+)+\s*", text) or any(unit not in _NANOS for _, unit in parts):
        raise LogError(400, f"invalid duration {text!r}")
    return sum(int(n) * _NANOS[unit] for n, unit in parts) // 1_000_000
