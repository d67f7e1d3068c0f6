"""Dump and restore of logs as a snapshot with a manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import core
from . import codec

VERSION = 1


def totals(rolled: DataFrame) -> DataFrame:
    return rolled.groupBy("topic").agg(
        F.count_distinct("segment_base", "partition").alias("file_count"), F.count("*").alias("records"), F.sum(core.disk_size(F.col("key"), F.col("value"))).cast("long").alias("total_bytes"), F.count_distinct("partition").alias("partitions")
    )


def dump(rolled: DataFrame, path: str, now_ms: int, topics: list[str] | None = None, keys: DataFrame | None = None) -> None:
    """Writes the log of the named topics (all if None) with record checksums, its manifest, and API keys only if given."""
    chosen = rolled if topics is None else rolled.where(F.col("topic").isin(topics))
    checked = codec.with_record(chosen).withColumn("crc", F.crc32("record")).drop("record")
    checked.write.mode("errorifexists").partitionBy("topic").parquet(f"{path}/log")
    manifest = totals(chosen).agg(F.collect_list("topic").alias("topics"), F.sum("file_count").alias("file_count"), F.sum("total_bytes").alias("total_bytes"), F.sum("records").alias("records"))
    manifest = manifest.select(F.lit(VERSION).alias("version"), F.lit(now_ms).alias("created_at_ms"), F.array_sort("topics").alias("topics"), F.lit(keys is not None).alias("includes_keys"), "file_count", "total_bytes", "records")
    manifest.coalesce(1).write.parquet(f"{path}/manifest")
    if keys is not None:
        keys.write.parquet(f"{path}/keys")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, after the snapshot's records and checksums were compared with it."""
    manifest = spark.read.parquet(f"{path}/manifest")
    m = manifest.first()
    if m is None or m["version"] != VERSION:
        raise model.LogError(400, "unknown manifest")
    if any(t in (".", "..") or "/" in t for t in m["topics"]):
        raise model.LogError(400, "path not allowed")
    log = spark.read.parquet(f"{path}/log")
    bad, n = codec.with_record(log).agg(F.count_if(F.crc32("record") != F.col("crc")), F.count("*")).first()
    if bad or n != (m["records"] or 0):
        raise model.LogError(400, f"{bad} damaged records, {n} of {m['records']}")
    return manifest


def restore(spark: SparkSession, path: str, target: str, with_keys: bool = False, most_bytes: int = 1 << 50) -> str | None:
    """Verifies a snapshot, writes it beside the target, moves an old target aside and the new one in; returns where the old one went. Keys come only if asked for."""
    m = verify(spark, path).first()
    if (m["total_bytes"] or 0) > most_bytes:
        raise model.LogError(400, "the snapshot is too large")
    if with_keys and not m["includes_keys"]:
        raise model.LogError(400, "the snapshot has no keys")
    staged = f"{target}.staged-{uuid.uuid4().hex[:8]}"
    spark.read.parquet(f"{path}/log").drop("crc").write.partitionBy("topic").parquet(f"{staged}/log")
    if with_keys:
        spark.read.parquet(f"{path}/keys").write.parquet(f"{staged}/keys")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(target).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = None
    if fs.exists(hadoop(target)):
        aside = f"{target}.old-{uuid.uuid4().hex[:8]}"
        fs.rename(hadoop(target), hadoop(aside))
    fs.rename(hadoop(staged), hadoop(target))
    return aside
