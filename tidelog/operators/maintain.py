"""Retention, compaction and the cold tier."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import core
from ..model import LogError


def retention_plan(segments: DataFrame, now_ms: int, retention_ms: int | None = None, retention_bytes: int | None = None, keys: tuple[str, ...] = ("partition",)) -> DataFrame:
    """Adds victim: sealed segments of partitions with at least two whose newest record is older than the limit, or that lie, oldest first, within the bytes by
    which the partition is over budget. The size walk counts every segment it passes, so it is a prefix sum."""
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("size_bytes").over(w.orderBy("segment_base").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = F.sum("size_bytes").over(w) - (retention_bytes if retention_bytes is not None else 0)
    by_time = F.coalesce(F.col("max_ts") < now_ms - retention_ms, F.lit(False)) if retention_ms is not None else F.lit(False)
    by_size = (over > 0) & (before < over) if retention_bytes is not None else F.lit(False)
    return segments.withColumn("_n", F.count("*").over(w)).withColumn("victim", ~F.col("is_active") & (F.col("_n") >= 2) & (by_time | by_size)).drop("_n")


def retention_report(planned: DataFrame, keys: tuple[str, ...] = ("partition",)) -> DataFrame:
    left = F.min(F.when(~F.col("victim"), F.col("segment_base")))
    return planned.groupBy(*keys).agg(left.alias("start_offset"), F.count_if("victim").alias("segments_deleted"), F.coalesce(F.sum(F.when(F.col("victim"), F.col("size_bytes"))), F.lit(0)).cast("long").alias("bytes_reclaimed"))


def apply_retention(rolled: DataFrame, planned: DataFrame, keys: tuple[str, ...] = ("partition",)) -> DataFrame:
    """The records of segments that stay. The victims are few rows against the log; AQE broadcasts them if they are small."""
    return rolled.join(planned.where("victim").select(*keys, "segment_base"), [*keys, "segment_base"], "left_anti")


def compaction_marks(rolled: DataFrame, now_ms: int, tombstone_retention_ms: int, keys: tuple[str, ...] = ("partition",)) -> DataFrame:
    """Adds sealed and keep. Among sealed records of a partition with at least two segments the latest of each key stays, unless it is a tombstone past its time;
    keyless records and the active segment stay. The active base and the latest of each key are windows, and rows clustered by keys are clustered by (keys, key) as well, so
    the rolled log is read once and moves once; the work is by partition, as the roll is."""
    place = Window.partitionBy(*keys)
    marked = rolled.withColumn("sealed", F.col("segment_base") < F.max("segment_base").over(place))
    last = F.max(F.when(F.col("sealed"), F.col("offset"))).over(Window.partitionBy(*keys, "key"))
    expired = core.is_tombstone(F.col("value")) & (F.col("timestamp_ms") < now_ms - tombstone_retention_ms)
    latest = (F.col("offset") == last) & ~F.coalesce(expired, F.lit(False))
    return marked.withColumn("keep", ~F.col("sealed") | F.col("key").isNull() | latest)


def compaction_report(marks: DataFrame, keys: tuple[str, ...] = ("partition",)) -> DataFrame:
    sealed = F.col("sealed")
    return marks.groupBy(*keys).agg(
        F.count_if(sealed & F.col("keep")).alias("kept"),
        F.count_if(sealed & ~F.col("keep")).alias("dropped"),
        F.when(F.count_if(sealed & ~F.col("keep")) > 0, F.count_distinct(F.when(sealed, F.col("segment_base")))).otherwise(0).cast("long").alias("sealed_merged"),
    )


def compact(rolled: DataFrame, now_ms: int, tombstone_retention_ms: int, keys: tuple[str, ...] = ("partition",)) -> DataFrame:
    """The log after a pass: what stays, sealed records in one segment at the lowest base. A partition in which nothing is dropped is left as it was."""
    place = Window.partitionBy(*keys)
    marks = compaction_marks(rolled, now_ms, tombstone_retention_ms, keys)
    told = marks.withColumn("_lowest", F.min("segment_base").over(place)).withColumn("_changed", F.max(~F.col("keep")).over(place))
    base = F.when(F.col("sealed") & F.col("_changed"), F.col("_lowest")).otherwise(F.col("segment_base"))
    return told.where("keep").withColumn("segment_base", base).drop("sealed", "keep", "_lowest", "_changed")


def retained(rolled: DataFrame, now_ms: int, retention_ms: int | None = None, retention_bytes: int | None = None, keys: tuple[str, ...] = ("partition",)) -> DataFrame:
    """The records that retention_plan() over the same log would leave, by windows over its rows: the log is read once, and a plan isn't joined back to it."""
    place = Window.partitionBy(*keys)
    base, order = F.col("segment_base"), place.orderBy("segment_base")
    told = rolled.withColumn("_active", base == F.max("segment_base").over(place))
    dead = F.lit(False)
    if retention_ms is not None:
        told = told.withColumn("_newest", F.max("timestamp_ms").over(Window.partitionBy(*keys, "segment_base")))
        dead = F.coalesce(F.col("_newest") < now_ms - retention_ms, F.lit(False))
    if retention_bytes is not None:
        before = F.coalesce(F.sum("size").over(order.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
        told = told.withColumn("_before", before).withColumn("_over", F.sum("size").over(place) - retention_bytes)
        dead = dead | ((F.col("_over") > 0) & (F.col("_before") < F.col("_over")))
    # The active segment is one, so a partition with a victim has two segments at least.
    return told.where(F.col("_active") | ~dead).select(*rolled.columns)


def run_policy(rolled: DataFrame, policy: str, now_ms: int, retention_ms: int | None, retention_bytes: int | None, tombstone_retention_ms: int, keys: tuple[str, ...] = ("partition",)) -> DataFrame:
    """One maintenance pass of a topic. Retention is skipped when both limits are unset."""
    if "compact" in policy:
        rolled = compact(rolled, now_ms, tombstone_retention_ms, keys)
    if "delete" in policy and (retention_ms is not None or retention_bytes is not None):
        rolled = retained(rolled, now_ms, retention_ms, retention_bytes, keys)
    return rolled


def offload(rolled: DataFrame, planned: DataFrame, cold_path: str, keys: tuple[str, ...] = ("partition",)) -> int:
    """Copies victims to the cold tier, checks the count, and returns it; only then may the caller drop them. A segment's folder is replaced whole, so a pass
    that failed midway can run again."""
    victims = rolled.join(planned.where("victim").select(*keys, "segment_base"), [*keys, "segment_base"], "left_semi")
    victims.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys, "segment_base").parquet(cold_path)
    spark = rolled.sparkSession
    want = victims.count()
    bases = planned.where("victim").select(*keys, "segment_base")
    have = spark.read.parquet(cold_path).join(bases, [*keys, "segment_base"], "left_semi").count()
    if have != want:
        raise IOError(f"cold tier has {have} of {want} records")
    return want


def cold_bases(spark, cold_path: str, keys: tuple[str, ...] = ("partition",)) -> DataFrame:
    return spark.read.parquet(cold_path).select(*keys, F.col("segment_base").cast("long").alias("segment_base")).distinct().orderBy(*keys, "segment_base")


def retrieve(spark, cold_path: str, topic: str | None = None, partition: int | None = None, base: int | None = None) -> DataFrame:
    """Cold records, of one topic, partition or segment where given; the folders of others aren't read."""
    out = spark.read.parquet(cold_path)
    for column, value in (("topic", topic), ("partition", partition), ("segment_base", base)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if base is not None and out.isEmpty():
        raise LogError(404, "no such cold segment")
    return out


def _remove(spark, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def delete_cold(spark, cold_path: str, topic: str, partition: int, base: int) -> None:
    """Removes one segment of a cold tier laid out by (topic, partition); an absent one is no error."""
    _check(topic)
    _remove(spark, f"{cold_path}/topic={topic}/partition={int(partition)}/segment_base={int(base)}")


def purge_cold(spark, cold_path: str, topic: str) -> None:
    """Removes a topic from a cold tier laid out by (topic, partition); an absent one is no error."""
    _check(topic)
    _remove(spark, f"{cold_path}/topic={topic}")


def _check(topic: str) -> None:
    """A topic becomes part of a path, so its name is checked first."""
    if not re.fullmatch(model.NAME_PATTERN, topic) or topic in (".", "..") or topic.endswith("\n"):
        raise LogError(400, "bad topic name")
