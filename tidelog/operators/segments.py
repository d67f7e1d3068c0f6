"""Segments of a partition: roll, sparse index, statistics and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import core
from .folds import ordered_fold


def roll(log: DataFrame, segment_bytes: int, keys: tuple[str, ...] = ("partition",)) -> DataFrame:
    """Adds size and segment_base: in offset order a record that would pass segment_bytes starts a segment; a larger record has one of its own."""

    def start() -> list[int]:
        return [0, 0]  # base, bytes so far

    def step(state: list[int], row: tuple[int, int]) -> tuple[int]:
        offset, size = row
        if state[1] == 0 or state[1] + size > segment_bytes:
            state[0], state[1] = offset, 0
        state[1] += size
        return (state[0],)

    sized = log.withColumn("size", core.disk_size(F.col("key"), F.col("value")))
    return ordered_fold(sized, list(keys), ["offset"], ["offset", "size"], start, step, "segment_base bigint")


def positions(rolled: DataFrame, keys: tuple[str, ...] = ("partition",)) -> DataFrame:
    """Adds file_pos: the record's byte position in its segment."""
    w = Window.partitionBy(*keys, "segment_base").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    return rolled.withColumn("file_pos", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long"))


def sparse_index(rolled: DataFrame, interval: int = model.INDEX_INTERVAL_BYTES, keys: tuple[str, ...] = ("partition",)) -> DataFrame:
    """Rows (keys, segment_base, relative_offset, file_pos): a segment's first record, then each that lies interval or more behind the last entry."""

    def start() -> list[int]:
        return [-1]

    def step(state: list[int], row: tuple[int]) -> tuple[bool]:
        if state[0] >= 0 and row[0] < state[0] + interval:
            return (False,)
        state[0] = row[0]
        return (True,)

    marked = ordered_fold(positions(rolled, keys), [*keys, "segment_base"], ["offset"], ["file_pos"], start, step, "indexed boolean")
    return marked.where("indexed").select(*keys, "segment_base", (F.col("offset") - F.col("segment_base")).alias("relative_offset"), "file_pos")


def index_floor(targets: DataFrame, index: DataFrame, keys: tuple[str, ...] = ("partition",)) -> DataFrame:
    """As-of lookup: for each target (keys, target) the last index entry at or below it. One union and one window: the
    join on a range is never spelled out."""
    entries = index.select(*keys, (F.col("segment_base") + F.col("relative_offset")).alias("at"), F.struct("segment_base", "relative_offset", "file_pos").alias("entry"), F.lit(0).alias("side"))
    wanted = targets.select(*keys, F.col("target").alias("at"), F.lit(None).cast(entries.schema["entry"].dataType).alias("entry"), F.lit(1).alias("side"))
    w = Window.partitionBy(*keys).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = entries.unionByName(wanted).withColumn("entry", F.last("entry", ignorenulls=True).over(w)).where("side = 1")
    return found.select(*keys, F.col("at").alias("target"), "entry.segment_base", "entry.relative_offset", "entry.file_pos")


def stats(rolled: DataFrame, keys: tuple[str, ...] = ("partition",)) -> DataFrame:
    """A row for each segment."""
    by = rolled.groupBy(*keys, "segment_base").agg(
        (F.max("offset") + 1).alias("end_offset"), F.sum("size").cast("long").alias("size_bytes"), F.count("*").alias("record_count"), F.min("timestamp_ms").alias("min_ts"), F.max("timestamp_ms").alias("max_ts")
    )
    last = F.max("segment_base").over(Window.partitionBy(*keys))
    return by.withColumn("is_active", F.col("segment_base") == last)


def describe(segments: DataFrame, keys: tuple[str, ...] = ("partition",)) -> DataFrame:
    """A row for each partition: the start is the base of its first segment, the end its next offset."""
    return segments.groupBy(*keys).agg(F.min("segment_base").alias("start_offset"), F.max("end_offset").alias("end_offset"), F.count("*").alias("segment_count"), F.sum("size_bytes").cast("long").alias("size_bytes"))
