"""Structured Streaming pipelines over logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..model import PRODUCER_IDLE_MS, PRODUCER_WINDOW
from ..operators import log
from ..operators.idempotent import SequenceWindow

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def produce_to_log(records: DataFrame, path: str, partitions: int, order: list[str], checkpoint: str):
    """A query that routes each batch, gives it dense offsets behind those written, and appends it. A batch that was written before, told by its id, is skipped."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            written = spark.read.parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            written = None
        ends, keyless = None, 0
        if written is not None:
            if not written.where(F.col("batch_id") == batch_id).isEmpty():
                return
            ends = written.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))
            keyless = written.where("key is null").count()
        routed = log.route(batch, partitions, order, keyless)
        done = log.assign_offsets(routed, order, ends, ("topic", "partition")).select("topic", "partition", "offset", "timestamp_ms", "key", "value", F.lit(batch_id).alias("batch_id"))
        done.write.mode("append").partitionBy("topic", "partition").parquet(path)

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class DedupeProcessor(StatefulProcessor):
    """The sequence window of one (producer, partition), with a timer that forgets idle producers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, used_ms long")
        self.recent = handle.getListState("recent", "seq long, mark long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        window = SequenceWindow(self.last.get()[0], [tuple(r) for r in self.recent.get()]) if self.last.exists() else SequenceWindow()
        frame = pd.concat(list(rows)).sort_values("arrival")
        out = []
        for r in frame.itertuples():
            verdict, original = window.judge(int(r.sequence))
            if verdict == "accept":
                window.accept(int(r.sequence), int(r.arrival))
            out.append((key[0], int(key[1]), int(r.arrival), int(r.sequence), verdict, original))
        now = timerValues.getCurrentProcessingTimeInMs()
        if window.last is not None:
            self.last.update((window.last, now))
            self.recent.put(list(window.recent.items())[-PRODUCER_WINDOW:])
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(now + PRODUCER_IDLE_MS)
        yield pd.DataFrame(out, columns=["producer_id", "partition", "arrival", "sequence", "outcome", "original"]).astype({"original": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        self.recent.clear()
        yield from ()

    def close(self) -> None:
        pass


def dedupe(records: DataFrame) -> DataFrame:
    """Outcomes for a stream (producer_id, partition, sequence, arrival); rows of a batch are judged by arrival. Needs the RocksDB state store, STATE_STORE."""
    return records.groupBy("producer_id", "partition").transformWithStateInPandas(
        DedupeProcessor(), outputStructType="producer_id string, partition int, arrival long, sequence long, outcome string, original long", outputMode="Append", timeMode="ProcessingTime"
    )


def changelog_to_table(changes: DataFrame, path: str, checkpoint: str):
    """Keeps the latest value of each (topic, partition, key) of a log stream as versions <path>/v<batch>; the newest version is the table."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id > 0:
            batch = batch.unionByName(spark.read.parquet(f"{path}/v{batch_id - 1}"))
        latest = batch.where("key is not null").groupBy("topic", "partition", "key").agg(F.max_by(F.struct("offset", "timestamp_ms", "value"), "offset").alias("l"))
        latest.select("topic", "partition", "l.offset", "l.timestamp_ms", "key", "l.value").write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return changes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table(spark: SparkSession, path: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    newest = max(int(f.getPath().getName()[1:]) for f in fs.listStatus(hadoop(path)) if f.getPath().getName().startswith("v"))
    return spark.read.parquet(f"{path}/v{newest}")


def live_members(heartbeats: DataFrame) -> DataFrame:
    """The last heartbeat of each member, as a stream in update mode; the timeout is applied by the reader's clock."""
    return heartbeats.groupBy("group", "member_id").agg(F.max("at_ms").alias("last_heartbeat_ms"))
