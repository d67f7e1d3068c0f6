"""Topics: creation, configuration and removal."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..model import LogError

KINDS = dict(part.split() for part in model.TOPIC_CATALOG.split(", ")[2:])
FIELDS = list(KINDS)


def check_topic(name: str, partitions: int, config: dict) -> None:
    if not re.match(model.NAME_PATTERN, name) or name in (".", ".."):
        raise LogError(400, "bad topic name")
    if not 1 <= partitions <= model.MAX_PARTITIONS:
        raise LogError(400, "a topic has 1 to 10,000 partitions")
    if config.get("cleanup_policy") is not None and config["cleanup_policy"] not in model.CLEANUP_POLICIES:
        raise LogError(400, "unknown cleanup policy")
    size = config.get("segment_bytes")
    if size is not None and not model.SEGMENT_BYTES_MIN <= size <= model.SEGMENT_BYTES_MAX:
        raise LogError(400, "segment_bytes out of range")


def create(topics: DataFrame, name: str, partitions: int = 1, **config) -> DataFrame:
    check_topic(name, partitions, config)
    if not topics.where(F.col("name") == name).isEmpty():
        raise LogError(409, "the topic exists")
    row = topics.sparkSession.createDataFrame([(name, partitions, *[config.get(f) for f in FIELDS])], model.TOPIC_CATALOG)
    return topics.unionByName(row)


def resolved(topics: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Configurations with the broker's defaults filled in."""
    base = model.DEFAULT_CONFIG | (defaults or {})
    return topics.select("name", "partitions", *[F.coalesce(F.col(f), F.lit(base[f]).cast(KINDS[f])).alias(f) for f in FIELDS])


def patch(topics: DataFrame, name: str, **config) -> DataFrame:
    """Sets the given fields; a null keeps what is there, so a value once set can't be unset. The partition count is fixed."""
    check_topic(name, 1, config)
    if topics.where(F.col("name") == name).isEmpty():
        raise LogError(404, "no such topic")
    return topics.select("name", "partitions", *[F.when(F.col("name") == name, F.coalesce(F.lit(config.get(f)).cast(KINDS[f]), F.col(f))).otherwise(F.col(f)).alias(f) for f in FIELDS])


def purge(name: str, *tables: DataFrame) -> list[DataFrame]:
    """Tables with a topic (or name) column without the rows of a removed topic: catalog, log, commits, producer windows, cold segments."""
    return [t.where(F.col("topic" if "topic" in t.columns else "name") != name) for t in tables]


def listing(topics: DataFrame) -> DataFrame:
    return topics.orderBy("name")


def health(topics: DataFrame) -> DataFrame:
    """One row (status, topics_count): the catalogue could be read, and how many topics it has."""
    return topics.agg(F.lit("ok").alias("status"), F.count("*").alias("topics_count"))
