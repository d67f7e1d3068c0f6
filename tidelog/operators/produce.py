"""Whole produce requests: validate, route, judge sequences, number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from . import log
from .idempotent import numbers, request_verdicts

#: The checks of a request in their order; the first that any of its records fails is the answer.
CHECKS = ("forbidden", "unknown_topic", "too_many_records", "record_too_large", "quota_exceeded", "bad_producer_id", "sequence_required", "negative_sequence", "partition_out_of_range")


def produce(
    records: DataFrame,
    partitions: int,
    order: list[str],
    mark: str,
    next_offsets: DataFrame | None = None,
    start: int = 0,
    ranges: int | None = None,
    can_write: Column | None = None,
    exists: Column | None = None,
    tokens_ok: Column | None = None,
    state: DataFrame | None = None,
) -> DataFrame:
    """The answer for every record of a topic: its columns with partition, offset, duplicate and error.

    records: request_id, producer_id, sequence, key, value, hint, the order columns and mark, a bigint that names a record. A request with any invalid record is
    refused whole, with partition, offset and duplicate null; so is one with a gap or a low sequence, whose records keep their own verdict as the error. Only accepted
    records are numbered; a duplicate has the offset of what it repeats. Routing precedes the judging of sequences, so a keyless retry may meet another partition.
    The three columns of conditions default to true. state: the producers' windows before (producer_state()), which go on.
    """
    true, columns = F.lit(True), records.columns
    given = [true if c is None else c for c in (can_write, exists, tokens_ok)]
    checks = F.array(*map(F.lit, CHECKS))

    def failing(count: int):
        error = log.produce_error(F.lit(partitions), given[0], given[1], F.lit(count), given[2], F.col("producer_id").isNotNull())
        return F.min(F.array_position(checks, error)).cast("int")

    # What a request fails is a hash aggregate, for requests of few records and of too many, so no request is ever gathered here.
    most = model.MAX_PRODUCE_RECORDS
    failed = records.groupBy("request_id").agg(F.when(F.count("*") > most, failing(most + 1)).otherwise(failing(0)).alias("_check"))
    failed = failed.where("_check is not null").select("request_id", F.element_at(checks, F.col("_check")).alias("error"))
    # Answers are made of narrow rows and meet the records at the end, by mark; each step is taken once.
    long, whole = F.lit(None).cast("long"), ["request_id", "producer_id", "sequence", "key", "hint", "topic", mark, *order]
    narrow = records.select(*[c for c in columns if c in whole])
    refused = narrow.join(failed, "request_id").select(mark, F.lit(None).cast("int").alias("partition"), long.alias("offset"), F.lit(None).cast("boolean").alias("duplicate"), "error")

    routed = log.route(narrow.join(failed, "request_id", "left_anti").select(*narrow.columns), partitions, order, start, ranges)
    plain = routed.where("producer_id is null").withColumn("outcome", F.lit("accept")).withColumn("original", long).withColumn("known_offset", long)
    verdicts = request_verdicts(routed.where("producer_id is not null"), order, mark, state)
    placed = numbers(plain.select(*verdicts.columns).unionByName(verdicts), ["partition"], order, mark, next_offsets, ranges)
    taken = F.col("outcome").isin("accept", "duplicate")
    answers = placed.where(~taken | F.col("offset").isNotNull()).select(
        mark, F.when(taken, F.col("partition")).alias("partition"), "offset", F.when(taken, F.col("outcome") == "duplicate").alias("duplicate"), F.when(~taken, F.col("outcome")).alias("error")
    )
    return records.join(answers.unionByName(refused), mark).select(*columns, "partition", "offset", "duplicate", "error")
