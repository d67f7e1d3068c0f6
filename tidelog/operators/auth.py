"""Keys, grants and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import core


def implies(granted: Column, wanted: Column) -> Column:
    """admin implies all, write implies read."""
    return (granted == wanted) | (granted == "admin") | ((granted == "write") & (wanted == "read"))


def grants(keys: DataFrame) -> DataFrame:
    """Rows (key_id, action, topic_prefix, disabled)."""
    return keys.select("key_id", F.coalesce("disabled", F.lit(False)).alias("disabled"), F.explode("acls").alias("a")).select("key_id", "disabled", "a.action", "a.topic_prefix")


def can(requests: DataFrame, acls: DataFrame) -> DataFrame:
    """requests (key_id, action, name) with allowed. The grants of a key are few; the join is on the key, the prefix is a condition of it."""
    rule = acls.where("not disabled").select(F.col("key_id").alias("_key"), F.col("action").alias("_action"), F.col("topic_prefix").alias("_prefix"))
    hit = (requests["key_id"] == rule["_key"]) & implies(rule["_action"], requests["action"]) & core.prefix_match(rule["_prefix"], requests["name"])
    allowed = requests.join(rule, hit, "left_semi").withColumn("allowed", F.lit(True)).select("key_id", "action", "name", "allowed").distinct()
    return requests.join(allowed, ["key_id", "action", "name"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def visible(names: DataFrame, acls: DataFrame, key_id: str, action: str = "read") -> DataFrame:
    """The names on which a key may act. The grants of one key are few rows."""
    rule = acls.where((F.col("key_id") == key_id) & ~F.col("disabled")).select(F.col("action").alias("_action"), F.col("topic_prefix").alias("_prefix"))
    return names.join(rule, implies(rule["_action"], F.lit(action)) & core.prefix_match(rule["_prefix"], names["name"]), "left_semi")


def is_admin(acls: DataFrame) -> DataFrame:
    return acls.where("not disabled and action = 'admin' and topic_prefix = '*'").select("key_id").distinct()


def may_claim(requests: DataFrame, acls: DataFrame) -> DataFrame:
    """requests (key_id, name) with may_claim: an admin, or any grant whose prefix covers the name, whatever its action."""
    rule = acls.where("not disabled").select(F.col("key_id").alias("_key"), F.col("action").alias("_action"), F.col("topic_prefix").alias("_prefix"))
    hit = (requests["key_id"] == rule["_key"]) & (core.prefix_match(rule["_prefix"], requests["name"]) | ((rule["_action"] == "admin") & (rule["_prefix"] == "*")))
    good = requests.join(rule, hit, "left_semi").select("key_id", "name").distinct().withColumn("may_claim", F.lit(True))
    return requests.join(good, ["key_id", "name"], "left").withColumn("may_claim", F.coalesce("may_claim", F.lit(False)))


def authenticate(attempts: DataFrame, keys: DataFrame) -> DataFrame:
    """attempts (secret) joined to the enabled key with its hash."""
    return attempts.withColumn("secret_sha256", core.secret_hash(F.col("secret"))).join(keys.where("not coalesce(disabled, false)"), "secret_sha256").drop("secret")


def produce_quota(requests: DataFrame, rates: DataFrame) -> DataFrame:
    """requests (key_id, t_ms, seq, bytes) with granted, tokens (left) and retry_s: a bucket as large as the rate, full at first, refilled by time. A request above the
    rate is refused with retry 1 s, one above the tokens with the time they take; a rate of 0 or null is no limit. A key's requests are folded as a stream."""
    from .folds import ordered_fold

    def start() -> list:
        return [None, None]  # tokens, time

    def step(state: list, row: tuple) -> tuple[bool, float, float]:
        t, n, rate = row
        if not rate:
            return True, 0.0, 0.0
        state[0] = float(rate) if state[0] is None else min(float(rate), state[0] + (t - state[1]) / 1000.0 * rate)
        state[1] = t
        if n > rate:
            return False, state[0], 1.0
        if n > state[0]:
            return False, state[0], (n - state[0]) / rate
        state[0] -= n
        return True, state[0], 0.0

    joined = requests.join(rates, "key_id", "left")
    return ordered_fold(joined, ["key_id"], ["t_ms", "seq"], ["t_ms", "bytes", "rate"], start, step, "granted boolean, tokens double, retry_s double")


def consume_quota(reads: DataFrame, rates: DataFrame) -> DataFrame:
    """reads (key_id, t_ms, seq, want, first_bytes, page_bytes) with granted, used and refused: a read reserves what the bucket has of want, takes its page up to that, and
    settles. In debt it is refused (granted and used null); a first record larger than the grant is taken from a full bucket only and leaves a debt, else the read is refused and costs
    nothing. first_bytes is the size of the first record of the page, page_bytes that of the whole page. A rate of 0 or null is no limit. Reads of a key follow each other."""
    from .folds import ordered_fold

    def start() -> list:
        return [None]

    def step(state: list, row: tuple) -> tuple[int | None, int | None, bool]:
        t, want, first, page, rate = row
        if not rate:
            return want, max(first, min(want, page)), False
        if state[0] is None:
            state[0] = ConsumeBucket(float(rate), t, 1000.0)
        bucket = state[0]
        bucket.refill(t)
        full = bucket.tokens >= bucket.rate
        granted = bucket.reserve(want, t)
        if granted is None:
            return None, None, True
        refused = first > granted and not full
        used = 0 if refused else first if first > granted else min(granted, max(page, first))
        bucket.settle(granted, used)
        return granted, used, refused

    joined = reads.join(rates, "key_id", "left")
    return ordered_fold(joined, ["key_id"], ["t_ms", "seq"], ["t_ms", "want", "first_bytes", "page_bytes", "rate"], start, step, "granted bigint, used bigint, refused boolean")


class ConsumeBucket:
    """Consume quota: a read reserves what it may, then settles what it took; debt blocks the next read, and a first record larger than the bucket needs it full."""

    def __init__(self, rate: float, now: float = 0.0, second: float = 1.0):
        """second: how many units of time are one."""
        self.rate, self.tokens, self.at, self.second = rate, rate, now, second

    def refill(self, now: float) -> None:
        self.tokens = min(self.rate, self.tokens + (now - self.at) / self.second * self.rate)
        self.at = now

    def reserve(self, want: int, now: float) -> int | None:
        """Bytes that may be read, or None where the reader must wait."""
        if not self.rate:
            return want
        self.refill(now)
        if self.tokens <= 0:
            return None
        got = min(want, int(self.tokens)) or 1
        self.tokens -= got
        return got

    def settle(self, reserved: int, took: int) -> None:
        """Gives back what wasn't used; a larger record leaves a debt."""
        if self.rate:
            self.tokens = min(self.rate, self.tokens + reserved - took)
