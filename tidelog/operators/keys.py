"""The table of API keys: create, list, revoke. Secrets are stored as hashes only."""

from __future__ import annotations

import hashlib
import re
import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..model import LogError

ACTIONS = ("read", "write", "admin")
SECRET_PREFIX = "tlk_"


def check_key(name: str, acls: list[tuple[str, str]]) -> None:
    """A grant is (action, prefix); the prefix * covers all names."""
    if not 1 <= len(name.encode()) <= 200:
        raise LogError(400, "a key's name has 1 to 200 bytes")
    if len(acls) > model.MAX_KEY_GRANTS:
        raise LogError(400, f"a key has at most {model.MAX_KEY_GRANTS} grants")
    for action, prefix in acls:
        if action not in ACTIONS:
            raise LogError(400, "unknown action")
        if prefix != "*" and not re.fullmatch(r"[A-Za-z0-9_.-]{1,200}", prefix):
            raise LogError(400, "a prefix is * or 1 to 200 of letters, digits, _, - and .")


def create(keys: DataFrame, name: str, acls: list[tuple[str, str]], now_ms: int, produce_bps: int | None = None, consume_bps: int | None = None, secret: str | None = None) -> tuple[DataFrame, str, str]:
    """(keys with the new one, its id, its secret). The secret is random unless given, and can't be read back from the table."""
    check_key(name, acls)
    secret = secret or SECRET_PREFIX + secrets.token_urlsafe(32)
    digest = hashlib.sha256(secret.encode()).hexdigest()
    key_id = "key_" + secrets.token_hex(8)  # Says nothing of the secret.
    row = (key_id, name, digest, [tuple(a) for a in acls], produce_bps, consume_bps, now_ms, False)
    return keys.unionByName(keys.sparkSession.createDataFrame([row], model.API_KEYS)), key_id, secret


def listing(keys: DataFrame) -> DataFrame:
    """Keys without their hashes, oldest first."""
    return keys.drop("secret_sha256").orderBy("created_at_ms", "key_id")


def revoke(keys: DataFrame, key_id: str) -> DataFrame:
    """The key stays listed, disabled."""
    if keys.where(F.col("key_id") == key_id).isEmpty():
        raise LogError(404, "no such key")
    return keys.withColumn("disabled", (F.col("key_id") == key_id) | F.coalesce("disabled", F.lit(False)))


def rates(keys: DataFrame, column: str) -> DataFrame:
    """Rows (key_id, rate) for the quota folds, of produce_bps or consume_bps; a key without one, or with 0, has no limit."""
    return keys.select("key_id", F.when(F.col(column) > 0, F.col(column)).alias("rate"))
