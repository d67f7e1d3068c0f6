"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from tidelog.operators import idempotent
from tidelog.plans.queries import SEQUENCES, events_log, events_source
from tidelog.streaming import pipelines

SF = "/root/testdata/sf0.001"


def test_produce_to_log(spark, tmp_path):
    source = events_source(spark, SF, "keyless")
    source.orderBy("ts", "event_id").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    pipelines.produce_to_log(stream, f"{tmp_path}/log", 4, ["ts", "event_id"], f"{tmp_path}/cp").awaitTermination(180)
    columns = ["partition", "offset", "timestamp_ms", "key", "value"]
    got = spark.read.parquet(f"{tmp_path}/log").select(*columns)
    want = events_log(spark, SF, "keyless").select(*columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_dedupe(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", pipelines.STATE_STORE)
    rows = spark.createDataFrame([(*r, i + 1) for i, r in enumerate(SEQUENCES)], "producer_id string, partition int, sequence long, arrival long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = pipelines.dedupe(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = out.writeStream.format("memory").queryName("deduped").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r["arrival"]: (r["outcome"], r["original"]) for r in spark.table("deduped").collect()}
    want = {r["arrival"]: (r["outcome"], r["original"]) for r in idempotent.classify(rows, ["arrival"], "arrival").collect()}
    assert got == want


def test_changelog(spark, tmp_path):
    rows = events_log(spark, SF)
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    pipelines.changelog_to_table(stream, f"{tmp_path}/t", f"{tmp_path}/cp").awaitTermination(180)
    got = {bytes(r["key"]): r["offset"] for r in pipelines.table(spark, f"{tmp_path}/t").collect()}
    want = {bytes(r["key"]): r["o"] for r in rows.groupBy("key").agg(F.max("offset").alias("o")).collect()}
    assert got == want
