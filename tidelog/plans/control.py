"""Queries of producer state, groups, schemas, keys, quotas and configuration over the driver tables, each with its equivalent in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import model
from ..functions import core
from ..operators import auth, catalog, consume, coord, groups, idempotent, log, maintain, metrics, registry
from ..operators.produce import produce
from .queries import ARRIVAL, DAY, KEYS, NOW_MS, PARTITIONS, SQL_MARKS, _plan, events_log, events_source, literal, query, rolled_log, sql, sql_plan, sql_values, text, values

# --- producers ----------------------------------------------------------------------------------------------------

#: Runs end and begin at this time; three producers, so that a window of 128 is too short for the retries of a whole run.
CUT = "2024-01-16 00:00:00"
CUT_MS = 1_705_363_200_000


def _sent(spark, sf):
    """Events as records of three producers with their sequences."""
    order = ["ts", "event_id"]
    source = log.route(events_source(spark, sf), PARTITIONS, order).withColumn("producer_id", F.concat(F.lit("p"), (F.col("key").cast("string").cast("long") % 3).cast("string")))
    place = Window.partitionBy("producer_id", "topic", "partition").orderBy(*order)
    return source.withColumn("sequence", F.row_number().over(place).cast("long") - 1).withColumn("attempt", F.lit(0)).withColumn("mark", F.col("event_id") * 3)


def _again(sent):
    return sent.where("event_id % 7 = 0").withColumn("attempt", F.lit(1)).withColumn("mark", F.col("event_id") * 3 + 1)


def _first_run(sent):
    run = sent.where(F.col("ts") < F.lit(CUT).cast("timestamp"))
    return idempotent.with_offsets(idempotent.classify(run, ARRIVAL, "mark"), ARRIVAL, "mark")


SQL_SENT = """, sent AS (SELECT *, row_number() OVER (PARTITION BY producer_id, partition ORDER BY ts, event_id) - 1 AS sequence, row_number() OVER (PARTITION BY partition ORDER BY ts, event_id) - 1 AS o
    FROM (SELECT *, 'p' || CAST(CAST(key AS BIGINT) % 3 AS VARCHAR) AS producer_id FROM routed))"""
SQL_EDGE = f", edge AS (SELECT producer_id, partition, max(sequence) AS last FROM sent WHERE ts < '{CUT}' GROUP BY ALL)"


@query(
    sql(
        f"""{SQL_SENT}{SQL_EDGE} SELECT s.event_id, 1 AS attempt, CASE WHEN ts >= '{CUT}' OR sequence > last - 128 THEN 'duplicate' ELSE 'too_low' END AS outcome, CASE WHEN ts >= '{CUT}' OR sequence > last - 128 THEN o END AS "offset"
    FROM sent s LEFT JOIN edge e ON s.producer_id = e.producer_id AND s.partition = e.partition WHERE event_id % 7 = 0 UNION ALL SELECT event_id, 0, 'accept', o FROM sent WHERE ts >= '{CUT}'"""
    )
)
def q47_producer_resume(spark, sf):
    """A second run goes on from the first one's state: retries of the newest 128 of a window get their former offsets."""
    sent = _sent(spark, sf)
    before = _first_run(sent)
    state = idempotent.producer_state(before)
    ends = before.where("not duplicate").groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))
    later = sent.where(F.col("ts") >= F.lit(CUT).cast("timestamp")).unionByName(_again(sent))
    judged = idempotent.classify(later, ARRIVAL, "mark", state)
    placed = idempotent.with_offsets(judged, ARRIVAL, "mark", ends).select("mark", "offset")
    return judged.join(placed, "mark", "left").select("event_id", "attempt", "outcome", "offset")


@query(
    sql(
        f"""{SQL_SENT}{SQL_EDGE}, next AS (SELECT producer_id, partition, event_id, sequence + CASE WHEN producer_id = 'p1' THEN 1000000 ELSE 0 END AS sequence FROM sent WHERE ts >= '{CUT}'),
    lead AS (SELECT n.producer_id, n.partition, min(sequence) AS first, any_value(last) AS last FROM next n LEFT JOIN edge e ON n.producer_id = e.producer_id AND n.partition = e.partition GROUP BY ALL)
    SELECT event_id, sequence, CASE WHEN last IS NULL OR first = last + 1 THEN 'accept' ELSE 'gap' END AS held, 'accept' AS forgotten FROM next JOIN lead USING (producer_id, partition)"""
    )
)
def q48_producer_forgotten(spark, sf):
    """Producer p1 jumps ahead: a gap by its state, accepted once the state was revoked."""
    sent = _sent(spark, sf)
    state = idempotent.producer_state(_first_run(sent))
    later = sent.where(F.col("ts") >= F.lit(CUT).cast("timestamp")).withColumn("sequence", F.col("sequence") + F.when(F.col("producer_id") == "p1", 1_000_000).otherwise(0))
    held = idempotent.classify(later, ARRIVAL, "mark", state).select("event_id", "sequence", F.col("outcome").alias("held"))
    free = idempotent.classify(later, ARRIVAL, "mark", idempotent.revoke(state, "p1")).select("event_id", F.col("outcome").alias("forgotten"))
    return held.join(free, "event_id")


@query(
    sql(
        f"""{SQL_SENT}{SQL_EDGE}, used AS (SELECT producer_id, partition, max(timestamp_ms) AS t FROM sent WHERE ts < '{CUT}' GROUP BY ALL), alive AS (SELECT producer_id FROM used GROUP BY 1 HAVING max(t) >= {CUT_MS - 3_600_000})
    SELECT e.producer_id, e.partition, e.last AS last_seen, s.o AS last_offset, CAST(least(e.last + 1, 128) AS BIGINT) AS held FROM edge e JOIN sent s ON s.producer_id = e.producer_id AND s.partition = e.partition AND s.sequence = e.last WHERE e.producer_id IN (SELECT producer_id FROM alive)"""
    )
)
def q49_state_carried(spark, sf):
    """State written in two steps, the second from the first, without producers idle for an hour."""
    sent = _sent(spark, sf).where(F.col("ts") < F.lit(CUT).cast("timestamp"))
    middle = F.lit("2024-01-08 00:00:00").cast("timestamp")
    one = idempotent.with_offsets(idempotent.classify(sent.where(F.col("ts") < middle), ARRIVAL, "mark"), ARRIVAL, "mark")
    state = idempotent.producer_state(one)
    ends = one.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))
    two = idempotent.with_offsets(idempotent.classify(sent.where(F.col("ts") >= middle), ARRIVAL, "mark", state), ARRIVAL, "mark", ends)
    left = idempotent.expire(idempotent.producer_state(two, state), CUT_MS, 3_600_000)
    return idempotent.listing(left.drop("topic")).join(left.select("producer_id", "partition", F.size("recent").cast("long").alias("held")), ["producer_id", "partition"])


@query(
    sql(
        f"""{SQL_SENT} SELECT event_id, 0 AS attempt, o AS "offset", false AS duplicate, NULL AS error FROM sent UNION ALL SELECT event_id, 1, o, true, NULL FROM sent WHERE sequence // 5 % 3 = 0
    UNION ALL SELECT event_id, 2, NULL, NULL, 'gap' FROM sent WHERE sequence // 5 % 11 = 5"""
    )
)
def q50_produce_sequences(spark, sf):
    """Whole requests of five records with sequences: some are sent again, some jump ahead and are refused."""
    sent = _sent(spark, sf).withColumn("number", F.expr("sequence div 5"))
    base = (F.substring("producer_id", 2, 9).cast("long") * PARTITIONS + F.col("partition")) * 100_000_000 + F.col("number")
    again = sent.where("number % 3 = 0").withColumn("attempt", F.lit(1))
    ahead = sent.where("number % 11 = 5").withColumn("attempt", F.lit(2)).withColumn("sequence", F.col("sequence") + 1_000_000)
    asked = sent.unionByName(again).unionByName(ahead).withColumn("request_id", base * 3 + F.col("attempt")).withColumn("mark", F.col("event_id") * 3 + F.col("attempt"))
    records = asked.drop("partition", "number").withColumn("hint", F.lit(None).cast("int"))
    return produce(records, PARTITIONS, ARRIVAL, "mark").select("event_id", "attempt", "offset", "duplicate", "error")


@query(
    """WITH r AS (SELECT event_id, ts, 'p' || CAST(user_id % 50 AS VARCHAR) AS producer_id, event_type AS key_id, value > 10 AS may_claim FROM events),
    owned AS (SELECT DISTINCT 'p' || CAST(user_id % 50 AS VARCHAR) AS producer_id, 'view' AS owner FROM events WHERE user_id % 50 < 5),
    fresh AS (SELECT producer_id, arg_min(key_id, (ts, event_id)) AS owner, min((ts, event_id)) AS since FROM r WHERE may_claim AND producer_id NOT IN (SELECT producer_id FROM owned) GROUP BY 1),
    ranked AS (SELECT producer_id, owner, row_number() OVER (PARTITION BY owner ORDER BY since) + CASE WHEN owner = 'view' THEN (SELECT count(*) FROM owned) ELSE 0 END > 8 AS over FROM fresh),
    known AS (SELECT producer_id, owner, false AS over FROM owned UNION ALL SELECT * FROM ranked)
    SELECT event_id, CASE WHEN owner IS NULL OR owner <> key_id THEN 'unavailable' WHEN over THEN 'producer_limit' END AS error FROM r LEFT JOIN known USING (producer_id)"""
)
def q51_producer_owners(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("producer_id", F.concat(F.lit("p"), (F.col("user_id") % 50).cast("string")))
    owners = e.where("user_id % 50 < 5").select("producer_id", F.lit("view").alias("owner")).distinct()
    asked = e.select("event_id", "ts", "producer_id", F.col("event_type").alias("key_id"), (F.col("value") > 10).alias("may_claim"))
    return idempotent.admit(asked, owners, ["ts", "event_id"], most=8).select("event_id", "error")


# --- reads, groups ------------------------------------------------------------------------------------------------


@query(
    sql(
        f"""{SQL_MARKS}, kept AS (SELECT partition, "offset" AS o FROM marks WHERE keep), ends AS (SELECT partition, max("offset") + 1 AS e FROM log GROUP BY 1), t AS (SELECT partition, "offset" - 3 AS target FROM log UNION ALL SELECT partition, e + 2 FROM ends)
    SELECT t.partition, target, o AS first_offset, CASE WHEN target >= e THEN target ELSE coalesce(o + 1, e) END AS next_offset FROM t JOIN ends USING (partition) ASOF LEFT JOIN kept ON t.partition = kept.partition AND greatest(t.target, 100) <= kept.o""",
        "mixed",
        roll=True,
    )
)
def q52_seek_compacted(spark, sf):
    """For every target the record that a read of one record gives in a compacted log that starts at 100, and where the next read goes on."""
    rolled = rolled_log(spark, sf, "mixed")
    ends = rolled.groupBy(*KEYS).agg((F.max("offset") + 1).alias("end_offset")).withColumn("start_offset", F.lit(100).cast("long"))
    kept = maintain.compact(rolled, NOW_MS, 10 * DAY, KEYS)
    targets = rolled.select(*KEYS, (F.col("offset") - 3).alias("target")).unionByName(ends.select(*KEYS, (F.col("end_offset") + 2).alias("target")))
    return consume.seek(targets, kept, ends, KEYS).select("partition", "target", "first_offset", "next_offset")


TOPICS = ["orders", "orders.eu", "ordersecret", "billing_v1", "events"]
READERS = [("k1", "read", "orders"), ("k4", "write", "billing_"), ("k4", "read", "events")]


def _committed(spark, sf):
    topic = F.element_at(F.array(*map(F.lit, TOPICS)), (F.col("user_id") % 5 + 1).cast("int"))
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.concat(F.lit("G"), (F.col("user_id") % 7).cast("string")).alias("group"), topic.alias("topic"), (F.col("event_id") % PARTITIONS).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.col("event_id").alias("commit_seq"))


SQL_COMMITTED = f"c AS (SELECT 'G' || CAST(user_id % 7 AS VARCHAR) AS g, [{', '.join(map(literal, TOPICS))}][user_id % 5 + 1] AS topic, CAST(event_id % {PARTITIONS} AS INTEGER) AS partition, max(event_id) AS o FROM events GROUP BY ALL)"


@query(f"""WITH {SQL_COMMITTED} SELECT 'k1' AS key_id, g AS "group", topic, partition, o AS "offset" FROM c WHERE topic IN ('orders', 'orders.eu') UNION ALL SELECT 'k4', g, topic, partition, o FROM c WHERE topic IN ('billing_v1', 'events')""")
def q53_offsets_visible(spark, sf):
    acls = values(spark, [(*r, False) for r in READERS], "key_id string, action string, topic_prefix string, disabled boolean")
    parts = [groups.offsets(_committed(spark, sf), acls, k).select(F.lit(k).alias("key_id"), *groups.PLACE, "offset") for k in ("k1", "k4")]
    return parts[0].unionByName(parts[1])


@query(f"""WITH {SQL_COMMITTED}, n AS (SELECT g, count(*) AS entries FROM c GROUP BY 1), r AS (SELECT *, sum(entries) OVER (ORDER BY g) AS total FROM n) SELECT g AS "group", entries, CAST(total AS BIGINT) AS total, total > 100 AS over FROM r""")
def q54_group_counts(spark, sf):
    return groups.running_counts(_committed(spark, sf), most=100)


@query(
    """WITH m AS (SELECT n_nationkey AS k, n_name AS member_id, n_regionkey AS r FROM nation), n AS (SELECT count(*) AS joined, count(*) FILTER (r = 2) AS gone, count(*) FILTER (r <> 2 AND 40000 - 1000 * k > 30000) AS stale FROM m)
    SELECT member_id, CAST(joined + gone + CASE WHEN stale > 0 THEN 1 ELSE 0 END AS BIGINT) AS generation, CAST(1000 * k AS BIGINT) AS last_heartbeat_ms, 'events,orders' AS topics,
    CASE WHEN 1000 * k < 20000 THEN 'rebalance_required' ELSE 'ok' END AS beat FROM m, n WHERE r <> 2 AND 40000 - 1000 * k <= 30000"""
)
def q55_group_members(spark, sf):
    """Members (one a nation) join, beat, leave and expire; what is left of the group as rows. The generation that a member knows is the last one, or an older one."""
    rows = spark.read.parquet(f"{sf}/nation.parquet").orderBy("n_nationkey").collect()
    parts, group = {"events": 40, "orders": 40}, coord.Group()
    for r in rows:
        group.join(["orders", "events", "orders"], parts, 0, r["n_name"])
    beats = {}
    for r in rows:
        if r["n_regionkey"] == 2:
            group.leave(r["n_name"], parts)
    for r in rows:
        at = 1000 * r["n_nationkey"]
        beats[r["n_name"]] = group.heartbeat(r["n_name"], group.generation - (at < 20_000), at)
    group.expire(40_000, parts, 30_000)
    told = coord.snapshot(spark, {"g": group})
    beat = values(spark, list(beats.items()), "member_id string, beat string")
    return told.select("member_id", "generation", "last_heartbeat_ms", F.array_join("topics", ",").alias("topics")).join(beat, "member_id")


# --- schemas, keys, quotas, configuration -------------------------------------------------------------------------


def _registry(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    subject = F.concat(F.lower("c_mktsegment"), F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("."), F.col("c_nationkey").cast("string"))).otherwise(""), F.when(F.col("c_custkey") % 2 == 0, "-value").otherwise("-key"))
    return c.select(F.col("c_custkey").cast("int").alias("id"), subject.alias("subject"), F.lit("avro").alias("type"), F.to_json(F.struct("c_name")).alias("schema"), F.lit(0).cast("long").alias("created_at_ms"))


SQL_REGISTRY = """s AS (SELECT CAST(c_custkey AS INTEGER) AS id, lower(c_mktsegment) || CASE WHEN c_nationkey % 3 = 0 THEN '.' || CAST(c_nationkey AS VARCHAR) ELSE '' END AS topic, CASE WHEN c_custkey % 2 = 0 THEN '-value' ELSE '-key' END AS suffix, '{"c_name":"' || c_name || '"}' AS schema FROM customer)"""


@query(f"WITH {SQL_REGISTRY} SELECT id, topic || suffix AS subject, schema FROM s WHERE topic = 'building' OR starts_with(topic, 'building.') OR topic = 'machinery.3'")
def q56_schemas_readable(spark, sf):
    acls = values(spark, [("k", "read", "building", False), ("k", "write", "machinery.3", False), ("k", "read", "auto", False), ("x", "read", "*", False)], "key_id string, action string, topic_prefix string, disabled boolean")
    return registry.listing(registry.readable(_registry(spark, sf), acls, "k")).select("id", "subject", "schema")


@query(
    """WITH k AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS key_id, sha256(c_name) AS h, c_custkey % 7 = 0 AS disabled, c_mktsegment AS seg, c_custkey AS n FROM customer),
    tried AS (SELECT event_id, sha256(printf('Customer#%09d', user_id)) AS h FROM events) SELECT event_id, key_id, seg = 'BUILDING' AND n % 2 = 0 AS is_admin FROM tried JOIN k USING (h) WHERE NOT disabled"""
)
def q57_authenticate(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").withColumn("key_id", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    keys = c.select("key_id", F.sha2(F.col("c_name").cast("binary"), 256).alias("secret_sha256"), (F.col("c_custkey") % 7 == 0).alias("disabled"))
    acls = c.select("key_id", F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("read").alias("action"), F.when(F.col("c_custkey") % 2 == 0, "*").otherwise("a").alias("topic_prefix"), F.lit(False).alias("disabled"))
    tried = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.format_string("Customer#%09d", F.col("user_id")).alias("secret"))
    admins = auth.is_admin(acls).withColumn("is_admin", F.lit(True))
    return auth.authenticate(tried, keys).select("event_id", "key_id").join(admins, "key_id", "left").select("event_id", "key_id", F.coalesce("is_admin", F.lit(False)).alias("is_admin"))


READ_MS = "CAST(100 * (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS BIGINT)"


@query(
    f"""WITH RECURSIVE s AS (SELECT event_type AS key_id, event_id, {READ_MS} AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, 50 + event_id % 300 AS want, CASE WHEN event_id % 40 = 0 THEN 1500 ELSE 20 END AS first, 20 + event_id % 400 AS have FROM events),
    f AS (SELECT key_id, event_id, i, t, 1000.0::DOUBLE AS tokens, NULL::BIGINT AS granted, NULL::BIGINT AS used, false AS refused FROM s WHERE false
    UNION ALL SELECT key_id, 0, 0, 0, 1000.0::DOUBLE, NULL, NULL, false FROM (SELECT DISTINCT key_id FROM s)
    UNION ALL SELECT s.key_id, s.event_id, s.i, s.t, CASE WHEN m.now <= 0 THEN m.now ELSE least(1000.0::DOUBLE, m.now - u.used) END, CASE WHEN m.now > 0 THEN g.granted END, CASE WHEN m.now > 0 THEN u.used END, m.now <= 0 OR (s.first > g.granted AND m.now < 1000)
    FROM f JOIN s ON s.key_id = f.key_id AND s.i = f.i + 1, LATERAL (SELECT CASE WHEN f.i = 0 THEN 1000.0::DOUBLE ELSE least(1000.0::DOUBLE, f.tokens + (s.t - f.t) / 1000.0::DOUBLE * 1000) END AS now) m,
    LATERAL (SELECT greatest(1, least(s.want, CAST(floor(m.now) AS BIGINT))) AS granted) g,
    LATERAL (SELECT CASE WHEN s.first > g.granted THEN CASE WHEN m.now >= 1000 THEN s.first ELSE 0 END ELSE least(g.granted, greatest(s.have, s.first)) END AS used) u)
    SELECT event_id, granted, CAST(used AS BIGINT) AS used, refused FROM f WHERE i > 0"""
)
def q58_consume_quota(spark, sf):
    """Reads of a key every tenth of a second at 1,000 bytes a second; one in 40 has a first record of 1,500 bytes."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")).cast("long")
    reads = e.select(F.col("event_type").alias("key_id"), "event_id", rank.alias("seq"), (rank * 100).alias("t_ms"), (F.col("event_id") % 300 + 50).alias("want"), F.when(F.col("event_id") % 40 == 0, 1500).otherwise(20).cast("long").alias("first_bytes"), (F.col("event_id") % 400 + 20).alias("page_bytes"))
    rates = reads.select("key_id").distinct().withColumn("rate", F.lit(1000).cast("long"))
    return auth.consume_quota(reads, rates).select("event_id", "granted", "used", "refused")


@query("SELECT replace(lower(r_name), ' ', '_') AS name, r_regionkey + 1 AS partitions, CAST(CASE WHEN r_regionkey = 1 THEN 5000 WHEN r_regionkey % 2 = 0 THEN 1000 END AS BIGINT) AS retention_ms, CASE WHEN r_regionkey = 1 THEN 'compact' ELSE 'delete' END AS cleanup_policy FROM region WHERE r_regionkey <> 3")
def q59_topic_catalog(spark, sf):
    """A topic a region: created, one patched, one removed."""
    topics = spark.createDataFrame([], model.TOPIC_CATALOG)
    names = [r["r_name"].lower().replace(" ", "_") for r in spark.read.parquet(f"{sf}/region.parquet").orderBy("r_regionkey").collect()]
    for i, name in enumerate(names):
        topics = catalog.create(topics, name, i + 1, retention_ms=1000 if i % 2 == 0 else None)
    topics = catalog.patch(topics, names[1], retention_ms=5000, cleanup_policy="compact")
    left = catalog.purge(names[3], topics)[0]
    return catalog.listing(catalog.resolved(left)).select("name", "partitions", "retention_ms", "cleanup_policy")


UPKEEP = ["retention_segments_deleted", "retention_bytes_reclaimed", "compaction_runs", "compaction_records_dropped"]


@query(
    sql(
        f"""{sql_plan(True, True)}{SQL_MARKS}, r AS (SELECT partition, count(*) FILTER (victim) AS a, CAST(coalesce(sum(size_bytes) FILTER (victim), 0) AS BIGINT) AS b FROM plan GROUP BY 1), k AS (SELECT partition, count(*) FILTER (sealed AND NOT keep) AS d FROM marks GROUP BY 1),
    l AS (SELECT partition, '{{topic="events",partition="' || partition || '"}} ' AS tag FROM r)
    SELECT 'es_retention_segments_deleted_total' || tag || a AS line FROM r JOIN l USING (partition) UNION ALL SELECT 'es_retention_bytes_reclaimed_total' || tag || b FROM r JOIN l USING (partition)
    UNION ALL SELECT 'es_compaction_runs_total' || tag || (CASE WHEN d > 0 THEN 1 ELSE 0 END) FROM k JOIN l USING (partition) UNION ALL SELECT 'es_compaction_records_dropped_total' || tag || d FROM k JOIN l USING (partition)
    UNION ALL SELECT 'es_topic_records_consumed_total{{topic="events"}} ' || count(*) FROM log UNION ALL SELECT 'es_topic_bytes_consumed_total{{topic="events"}} ' || CAST(sum(size - 32) AS BIGINT) FROM log""",
        segs=True,
    )
)
def q60_metrics_upkeep(spark, sf):
    """Counters of a retention and a compaction pass, and of one read of the whole log."""
    report = metrics.retention(maintain.retention_report(_plan(spark, sf, True, True), KEYS))
    passed = metrics.compaction(maintain.compaction_report(maintain.compaction_marks(rolled_log(spark, sf), NOW_MS, 10 * DAY, KEYS), KEYS))
    long = metrics.union(metrics.upkeep(report), metrics.upkeep(passed), metrics.topics(metrics.consumed(events_log(spark, sf))))
    return long.select(metrics.exposition(F.col("metric"), F.col("labels"), F.col("value")).alias("line"))


@query(
    r"""SELECT event_id, replace(replace(replace(props || chr(10) || '\', '\', '\\'), '"', '\"'), chr(10), '\n') AS label, event_type AS topic, lower(upper(event_type)) AS folded, props || chr(65533) AS shown FROM events"""
)
def q61_text_functions(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    subject = F.concat("event_type", F.when(F.col("event_id") % 2 == 0, "-key").otherwise("-value"))
    broken = F.concat(F.col("props").cast("binary"), F.unhex(F.lit("FF")))
    return e.select("event_id", core.label_escape(F.concat("props", F.lit("\n\\"))).alias("label"), core.subject_topic(subject).alias("topic"), F.lower(F.upper("event_type")).alias("folded"), core.as_text(broken).alias("shown"))
