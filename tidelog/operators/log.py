"""Produce: validation, routing and dense offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import core
from .folds import numbered


def route(records: DataFrame, partitions: int, order: list[str], start: int = 0, ranges: int | None = None) -> DataFrame:
    """Adds partition: an explicit hint, else the key's hash, else round robin over the keyless, hintless records of a topic in order (each topic's counter begins
    at start; without a column topic there is one). A hint out of range fails the job. records: key, hint (may be missing). ranges: see numbered()."""
    hint = F.col("hint") if "hint" in records.columns else F.lit(None).cast("int")
    n = F.lit(partitions)
    checked = F.when((hint < 0) | (hint >= n), F.raise_error(F.lit("partition out of range")).cast("int")).otherwise(hint)
    keyless = F.col("key").isNull() & hint.isNull()
    direct = F.when(hint.isNotNull(), checked).otherwise(core.key_partition(F.col("key"), n))
    # Only the records that need the counter are ordered as one sequence.
    counted = records.withColumn("_keyless", keyless)
    keyed = counted.where(~F.col("_keyless")).withColumn("partition", direct)
    robin = numbered(counted.where("_keyless"), ["topic" if "topic" in records.columns else "_keyless"], order, "partition", ranges).withColumn("partition", F.pmod(F.col("partition") + start, n).cast("int"))
    return keyed.unionByName(robin).drop("_keyless")


def assign_offsets(routed: DataFrame, order: list[str], next_offsets: DataFrame | None = None, keys: tuple[str, ...] = ("partition",), ranges: int | None = None) -> DataFrame:
    """Adds offset: dense from the partition's next offset (0 unless next_offsets has (partition, next_offset)). ranges: see numbered(); with them a hot
    partition is numbered by many tasks."""
    ranked = numbered(routed, list(keys), order, "offset", ranges)
    if next_offsets is None:
        return ranked
    joined = ranked.join(next_offsets, list(keys), "left")
    return joined.withColumn("offset", F.col("offset") + F.coalesce("next_offset", F.lit(0).cast("long"))).drop("next_offset")


def apply_explicit(existing_end: DataFrame, records: DataFrame) -> DataFrame:
    """Records with explicit offsets (replication): those below the partition's next offset were applied before and are skipped; a gap above stays."""
    joined = records.join(existing_end, ["topic", "partition"], "left")
    return joined.where(F.col("offset") >= F.coalesce("next_offset", F.lit(0))).drop("next_offset")


def produce_error(partitions: Column, can_write: Column, exists: Column, count: Column, tokens_ok: Column, has_producer: Column) -> Column:
    """The first check that a record's request fails, in the order of the checks, or null."""
    size = core.payload_bytes(F.col("key"), F.col("value"))
    return (
        F.when(~can_write, "forbidden")
        .when(~exists, "unknown_topic")
        .when(count > model.MAX_PRODUCE_RECORDS, "too_many_records")
        .when(size > model.MAX_RECORD_BYTES, "record_too_large")
        .when(~tokens_ok, "quota_exceeded")
        .when(has_producer & ~core.valid_id(F.col("producer_id")), "bad_producer_id")
        .when(has_producer & F.col("sequence").isNull(), "sequence_required")
        .when(has_producer & (F.col("sequence") < 0), "negative_sequence")
        .when((F.col("hint") < 0) | (F.col("hint") >= partitions), "partition_out_of_range")
    )


def append(log: DataFrame, path: str) -> None:
    """Writes log rows; directories by topic and partition give pruning, order within files gives offset statistics."""
    log.repartition("topic", "partition").sortWithinPartitions("topic", "partition", "offset").write.mode("append").partitionBy("topic", "partition").parquet(path)


def from_lines(spark, path: str, key: str | None = None, partition: int | None = None, first_sequence: int | None = None) -> DataFrame:
    """Records of the non-empty lines of text files, in order of file and line; sequences count from first_sequence."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")).where(F.length("value") > 0)
    rank = F.row_number().over(Window.orderBy("_file", "_block", "_line"))
    sequence = (rank - 1 + first_sequence).cast("long") if first_sequence is not None else F.lit(None).cast("long")
    return lines.select(F.lit(key).alias("key"), "value", F.lit(partition).cast("int").alias("hint"), sequence.alias("sequence"))
