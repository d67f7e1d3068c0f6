"""Gauges and counters in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import core


def _long(df: DataFrame, labels: list[str], series: dict[str, str]) -> DataFrame:
    """One pass over df: its columns become rows (metric, labels, value)."""
    tags = F.create_map(*[x for name in labels for x in (F.lit(name), F.col(name).cast("string"))])
    rows = F.array(*[F.struct(F.lit(metric).alias("metric"), F.col(column).cast("long").alias("value")) for metric, column in series.items()])
    return df.select(tags.alias("labels"), F.explode(rows).alias("r")).select("r.metric", "labels", "r.value")


def partitions(described: DataFrame) -> DataFrame:
    """described: topic, partition, start_offset, end_offset, size_bytes, segment_count."""
    return _long(described, ["topic", "partition"], {"es_partition_start_offset": "start_offset", "es_partition_end_offset": "end_offset", "es_partition_size_bytes": "size_bytes", "es_partition_segment_count": "segment_count"})


def topics(counters: DataFrame) -> DataFrame:
    """counters: topic and any of the four counters of its traffic, each named as its series without es_ and _total."""
    names = ["topic_records_produced", "topic_bytes_produced", "topic_records_consumed", "topic_bytes_consumed"]
    return _long(counters, ["topic"], {f"es_{n}_total": n for n in names if n in counters.columns})


def upkeep(counters: DataFrame) -> DataFrame:
    """counters: topic, partition and any of the four counters of maintenance passes, each named as its series without es_ and _total."""
    names = ["retention_segments_deleted", "retention_bytes_reclaimed", "compaction_runs", "compaction_records_dropped"]
    return _long(counters, ["topic", "partition"], {f"es_{n}_total": n for n in names if n in counters.columns})


def consumed(records: DataFrame) -> DataFrame:
    """Counters of the records (topic, key, value) that reads returned."""
    return records.groupBy("topic").agg(F.count("*").alias("topic_records_consumed"), F.sum(core.payload_bytes(F.col("key"), F.col("value"))).cast("long").alias("topic_bytes_consumed"))


def retention(report: DataFrame) -> DataFrame:
    """Counters of a retention pass from its report."""
    return report.select("topic", "partition", F.col("segments_deleted").alias("retention_segments_deleted"), F.col("bytes_reclaimed").alias("retention_bytes_reclaimed"))


def compaction(report: DataFrame) -> DataFrame:
    """Counters of a compaction pass from its report; a pass that drops nothing changes nothing and counts as no run."""
    return report.select("topic", "partition", (F.col("dropped") > 0).cast("long").alias("compaction_runs"), F.col("dropped").alias("compaction_records_dropped"))


def groups(lag: DataFrame) -> DataFrame:
    """lag: group, topic, partition, offset, lag."""
    return _long(lag, ["group", "topic", "partition"], {"es_group_committed_offset": "offset", "es_group_lag": "lag"})


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def exposition(metric: Column, labels: Column, value: Column) -> Column:
    """A line of the text format."""
    pairs = F.transform(F.map_entries(labels), lambda e: F.concat(e["key"], F.lit('="'), core.label_escape(e["value"]), F.lit('"')))
    return F.concat(metric, F.lit("{"), F.array_join(pairs, ","), F.lit("} "), value.cast("string"))


def produced(log: DataFrame) -> DataFrame:
    return log.groupBy("topic").agg(F.count("*").alias("topic_records_produced"), F.sum(core.payload_bytes(F.col("key"), F.col("value"))).cast("long").alias("topic_bytes_produced"))
