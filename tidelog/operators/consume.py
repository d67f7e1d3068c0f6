"""Fetch by offset with record and byte limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import core
from .folds import ordered_fold


def clamp(value: int, most: int) -> int:
    return max(1, min(value, most))


def fetch(rolled: DataFrame, partition: int, target: int, max_records: int = model.FETCH_RECORDS_DEFAULT, max_bytes: int = model.FETCH_BYTES_DEFAULT, start_offset: int = 0, high_watermark: int | None = None) -> DataFrame:
    """The records of one call: from target (at least start_offset), of the first segment that has any, cut at max_records or where the bytes pass max_bytes; the first
    record always comes. The limit bounds what is sorted: nothing beyond max_records of the scan is kept. rolled: with size and segment_base."""
    max_records, max_bytes = clamp(max_records, model.FETCH_RECORDS_MAX), clamp(max_bytes, model.FETCH_BYTES_MAX)
    found = rolled.where((F.col("partition") == partition) & (F.col("offset") >= max(target, start_offset)))
    if high_watermark is not None:
        found = found.where(F.lit(target < high_watermark) & (F.col("offset") < high_watermark))
    found = found.orderBy("offset").limit(max_records)
    order = Window.partitionBy("partition").orderBy("offset")
    cut = found.withColumn("_segment", F.first("segment_base").over(order)).withColumn("_bytes", F.sum("size").over(order)).withColumn("_rank", F.row_number().over(order))
    return cut.where((F.col("segment_base") == F.col("_segment")) & ((F.col("_rank") == 1) | (F.col("_bytes") <= max_bytes))).drop("_segment", "_bytes", "_rank")


def next_offset(page: DataFrame, target: int, high_watermark: int) -> int:
    """Where the next call goes on: behind the page, or at the watermark where nothing was left, or at the target where it lies beyond."""
    if target >= high_watermark:
        return target
    last = page.agg(F.max("offset")).first()[0]
    return last + 1 if last is not None else high_watermark


def seek(targets: DataFrame, log: DataFrame, ends: DataFrame, keys: tuple[str, ...] = ("partition",)) -> DataFrame:
    """For each target (keys, target) first_offset, the record that a read of one record gives, and next_offset, where the next read goes on: behind that record, at the end where
    no record is left (the rest is a gap), or at the target where it lies at or beyond the end. Compaction leaves gaps, so the first record is an as-of lookup upwards: one union and one window.
    ends: (keys, start_offset, end_offset); targets below the start are raised to it."""
    asked = targets.join(ends.select(*keys, "start_offset", "end_offset"), list(keys)).withColumn("_at", F.greatest("target", "start_offset"))
    none = F.lit(None).cast("long")
    stored = log.select(*keys, F.col("offset").alias("_at"), F.col("offset").alias("_offset"), none.alias("target"), none.alias("end_offset"))
    both = stored.unionByName(asked.select(*keys, "_at", none.alias("_offset"), "target", "end_offset"))
    upwards = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.col("_offset").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("first_offset", F.last("_offset", ignorenulls=True).over(upwards)).where("target is not null")
    goes_on = F.when(F.col("target") >= F.col("end_offset"), F.col("target")).otherwise(F.coalesce(F.col("first_offset") + 1, F.greatest("_at", "end_offset")))
    return found.withColumn("next_offset", goes_on).select(*keys, "target", "first_offset", "next_offset")


def pages(rolled: DataFrame, max_records: int, max_bytes: int, keys: tuple[str, ...] = ("partition",)) -> DataFrame:
    """All pages a consumer sees that reads each partition from its start: rows (keys, page, first_offset, next_offset, records, bytes)."""
    max_records, max_bytes = clamp(max_records, model.FETCH_RECORDS_MAX), clamp(max_bytes, model.FETCH_BYTES_MAX)

    def start() -> list:
        return [-1, None, 0, 0]  # page, segment, records, bytes

    def step(state: list, row: tuple[int, int]) -> tuple[int]:
        segment, size = row
        if segment != state[1] or state[2] == max_records or state[3] + size > max_bytes:
            state[0], state[1], state[2], state[3] = state[0] + 1, segment, 0, 0
        state[2] += 1
        state[3] += size
        return (state[0],)

    paged = ordered_fold(rolled, list(keys), ["offset"], ["segment_base", "size"], start, step, "page bigint")
    return paged.groupBy(*keys, "page").agg(F.min("offset").alias("first_offset"), (F.max("offset") + 1).alias("next_offset"), F.count("*").alias("records"), F.sum("size").cast("long").alias("bytes"))


def group_start(ends: DataFrame, commits: DataFrame, group: str) -> DataFrame:
    """Where a group goes on in each partition: its commit, else the partition's start. ends: (topic, partition, start_offset)."""
    mine = commits.where(F.col("group") == group).select("topic", "partition", F.col("offset").alias("committed"))
    return ends.join(mine, ["topic", "partition"], "left").withColumn("position", F.coalesce("committed", "start_offset"))


def encode(records: DataFrame, encoding: str | None = None) -> DataFrame:
    return records.withColumn("key", core.encoded(F.col("key"), encoding)).withColumn("value", core.encoded(F.col("value"), encoding))
