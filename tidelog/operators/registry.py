"""Schema registry."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import core
from ..model import LogError

TYPES = ("json_schema", "avro", "protobuf")


def required(schema: Column) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(schema, "$.required"), "array<string>"), F.array().cast("array<string>"))


def properties(schema: Column) -> Column:
    return F.coalesce(F.json_object_keys(F.get_json_object(schema, "$.properties")), F.array().cast("array<string>"))


def compatible(old: Column, new: Column) -> Column:
    """No new required field, no property gone; types aren't compared."""
    return (F.size(F.array_except(required(new), required(old))) == 0) & (F.size(F.array_except(properties(old), properties(new))) == 0)


def latest(registry: DataFrame) -> DataFrame:
    return registry.groupBy("subject").agg(F.max("id").alias("id"), F.max_by("type", "id").alias("type"), F.max_by("schema", "id").alias("schema"))


def by_id(registry: DataFrame, id_: int) -> DataFrame:
    return registry.where(F.col("id") == id_)


def listing(registry: DataFrame) -> DataFrame:
    return registry.orderBy("id")


def readable(registry: DataFrame, acls: DataFrame, key_id: str) -> DataFrame:
    """Schemas whose subject's topic the key may read; others look absent."""
    from .auth import visible

    names = registry.withColumn("name", core.subject_topic(F.col("subject")))
    return visible(names, acls, key_id).drop("name")


def register(registry: DataFrame, subject: str, type_: str, schema: str, now_ms: int) -> tuple[DataFrame, int]:
    """(registry with the new entry, its id)."""
    spark = registry.sparkSession
    check = spark.range(1).select(core.valid_name(F.lit(subject)).alias("ok")).first()["ok"]
    if not check:
        raise LogError(400, "bad subject")
    if type_ not in TYPES:
        raise LogError(400, "unknown schema type")
    if not 1 <= len(schema.encode()) <= model.MAX_SCHEMA_BYTES:
        raise LogError(400, "a schema has 1 byte to 512 KiB")
    try:
        json.loads(schema)
    except ValueError as e:
        raise LogError(400, "a schema is JSON") from e
    count, top = registry.agg(F.count("*"), F.max("id")).first()
    if count >= model.MAX_SCHEMAS:
        raise LogError(429, "the registry is full")
    old = latest(registry.where(F.col("subject") == subject)).first()
    if old is not None and type_ == "json_schema":
        if not spark.range(1).select(compatible(F.lit(old["schema"]), F.lit(schema)).alias("ok")).first()["ok"]:
            raise LogError(400, "incompatible schema")
    new = spark.createDataFrame([((top or 0) + 1, subject, type_, schema, now_ms)], model.SCHEMA_REGISTRY)
    return registry.unionByName(new), (top or 0) + 1
