"""A data source over byte logs: <root>/<topic>/<partition>/<20-digit base>.log, batch and stream.

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ByteLogSource)
    spark.read.format("tidelog").option("path", root).option("mode", "PERMISSIVE").load()

Batch: one input partition for each segment; filters on topic and partition prune files, and filters on offset prune whole segments by their bases.
Stream: offsets are the next offsets of each partition; a batch reads ranges between them. The root must be on a file system that all nodes mount.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from . import codec

SCHEMA = "topic string, partition int, offset bigint, timestamp_ms bigint, key binary, value binary"


@dataclass
class Segment(InputPartition):
    topic: str
    partition: int
    path: str
    low: int = 0
    high: int = (1 << 63) - 1


def segments(root: str) -> list[tuple[str, int, int, str]]:
    """(topic, partition, base, path) in order."""
    found = []
    for topic in sorted(os.listdir(root)):
        for partition in sorted(os.listdir(f"{root}/{topic}"), key=int):
            folder = f"{root}/{topic}/{partition}"
            found += [(topic, int(partition), int(name[:-4]), f"{folder}/{name}") for name in sorted(os.listdir(folder)) if name.endswith(".log")]
    return found


def read(part: Segment, failfast: bool) -> Iterator[tuple]:
    with open(part.path, "rb") as f:
        for offset, timestamp, key, value in codec.scan(f.read(), failfast):
            if part.low <= offset < part.high:
                yield part.topic, part.partition, offset, timestamp, key, value


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.failfast = options["path"], options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.low, self.high, self.equal = 0, (1 << 63) - 1, {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            if isinstance(f, EqualTo) and name in ("topic", "partition"):
                self.equal[name] = f.value
            elif name == "offset" and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
            elif name == "offset" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif name == "offset" and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            yield f  # pruning is by segment, so Spark still checks each row

    def partitions(self):
        found = segments(self.root)
        out = []
        for i, (topic, partition, base, path) in enumerate(found):
            following = found[i + 1][2] if i + 1 < len(found) and found[i + 1][:2] == (topic, partition) else None
            if self.equal.get("topic", topic) != topic or self.equal.get("partition", partition) != partition:
                continue
            if base >= self.high or (following is not None and following <= self.low):
                continue
            out.append(Segment(topic, partition, path, self.low, self.high))
        return out

    def read(self, partition: Segment):
        yield from read(partition, self.failfast)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.failfast = options["path"], options.get("mode", "PERMISSIVE").upper() == "FAILFAST"

    def initialOffset(self) -> dict:
        first: dict[str, int] = {}
        for topic, partition, base, _ in segments(self.root):
            first.setdefault(f"{topic}/{partition}", base)
        return first

    def latestOffset(self) -> dict:
        """The high watermark of each partition: behind the last valid record."""
        last = {f"{t}/{p}": (base, path) for t, p, base, path in segments(self.root)}
        out = {}
        for place, (base, path) in last.items():
            with open(path, "rb") as f:
                out[place] = max((r[0] + 1 for r in codec.scan(f.read())), default=base)
        return out

    def partitions(self, start: dict, end: dict):
        found = segments(self.root)
        out = []
        for i, (topic, partition, base, path) in enumerate(found):
            place = f"{topic}/{partition}"
            low, high = start.get(place, 0), end.get(place, 0)
            following = found[i + 1][2] if i + 1 < len(found) and found[i + 1][:2] == (topic, partition) else None
            if low < high and base < high and (following is None or following > low):
                out.append(Segment(topic, partition, path, low, high))
        return out

    def read(self, partition: Segment):
        yield from read(partition, self.failfast)

    def commit(self, end: dict) -> None:
        pass


class ByteLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidelog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def streamReader(self, schema):
        return StreamReader(self.options)


def write(rolled, root: str) -> None:
    """Writes rolled rows (with segment_base) as segment files; a task writes whole partitions in offset order, segment by segment, as a stream."""

    def run(batches):
        import pyarrow as pa

        current, out, n = None, None, 0
        for batch in batches:
            for topic, partition, base, offset, timestamp, key, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (topic, partition, base) != current:
                    if out:
                        out.close()
                    current = (topic, partition, base)
                    os.makedirs(f"{root}/{topic}/{partition}", exist_ok=True)
                    out = open(f"{root}/{topic}/{partition}/{base:020d}.log", "wb")
                out.write(codec.encode(offset, timestamp, key, value))
                n += 1
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows = rolled.select("topic", "partition", "segment_base", "offset", "timestamp_ms", "key", "value").repartition("topic", "partition").sortWithinPartitions("topic", "partition", "offset")
    rows.mapInArrow(run, "n long").agg({"n": "sum"}).collect()
