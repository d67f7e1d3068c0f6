"""Consumer-group offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core
from ..model import MAX_GROUP_ENTRIES

PLACE = ["group", "topic", "partition"]


def latest_commits(commits: DataFrame) -> DataFrame:
    """The committed offset of each place: the last write wins, even if it goes back."""
    return commits.groupBy(*PLACE).agg(F.max_by("offset", "commit_seq").alias("offset"), F.max("commit_seq").alias("commit_seq"))


def lag(commits: DataFrame, ends: DataFrame) -> DataFrame:
    """Adds end_offset and lag to committed places; those whose partition is gone are dropped. ends: (topic, partition, end_offset)."""
    return latest_commits(commits).join(ends.select("topic", "partition", "end_offset"), ["topic", "partition"]).withColumn("lag", core.saturating_sub(F.col("end_offset"), F.col("offset")))


def reset(commits: DataFrame, starts: DataFrame, topic: str) -> tuple[DataFrame, DataFrame]:
    """(commits with every existing entry on the topic set to its partition's start, report of groups and entries)."""
    now = latest_commits(commits)
    seq = now.agg(F.max("commit_seq")).first()[0] or 0
    entries = now.where(F.col("topic") == topic).join(starts.select("topic", "partition", "start_offset"), ["topic", "partition"]).select(*PLACE, F.col("start_offset").alias("offset"), F.lit(seq + 1).cast("long").alias("commit_seq"))
    report = entries.agg(F.count_distinct("group").alias("groups"), F.count("*").alias("entries"))
    return commits.select(*PLACE, "offset", "commit_seq").unionByName(entries), report


def counts(commits: DataFrame) -> DataFrame:
    return latest_commits(commits).groupBy("group").agg(F.count("*").alias("entries"))


def running_counts(commits: DataFrame, most: int = MAX_GROUP_ENTRIES) -> DataFrame:
    """Groups by name with their entries, the entries up to and with each, and whether those pass the limit. One row a group (100,000 at most), so one window holds them."""
    total = F.sum("entries").over(Window.orderBy("group")).cast("long")
    return counts(commits).withColumn("total", total).withColumn("over", F.col("total") > most)


def offsets(commits: DataFrame, acls: DataFrame, key_id: str, group: str | None = None) -> DataFrame:
    """The committed offsets, of one group where given, on topics that the key may read; others look absent."""
    from .auth import visible

    mine = latest_commits(commits if group is None else commits.where(F.col("group") == group))
    return visible(mine.withColumn("name", F.col("topic")), acls, key_id).drop("name")


def claim_error(groups: DataFrame) -> DataFrame:
    """Adds error to requests (name, key_id, is_admin, owner, folded_owner): a group belongs to its first user; a foreign one is refused like an absent one, and so
    is a name that differs from an existing one in case only (exists_as)."""
    return groups.withColumn(
        "error",
        F.when(~core.valid_name(F.col("name")), "bad_name")
        .when(F.col("exists_as").isNotNull() & (F.col("exists_as") != F.col("name")) & (F.lower("exists_as") == F.lower("name")), "case_collision")
        .when(F.col("owner").isNotNull() & (F.col("owner") != F.col("key_id")) & ~F.col("is_admin"), "not_found"),
    )
