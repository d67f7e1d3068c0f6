"""The catalogue of queries over logs made from the driver tables, each with its equivalent in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import core
from ..operators import auth, catalog, consume, coord, groups, idempotent, log, maintain, metrics, registry, segments

PARTITIONS, SEGMENT_BYTES = 4, 4096
#: 2024-01-31 00:00:00 UTC, a day after the last event.
NOW_MS = 1_706_659_200_000
DAY = 86_400_000
KEYS = ("topic", "partition")


def text(column: str):
    return F.col(column).cast("string").alias(column)


# --- logs from tables ---------------------------------------------------------------------------------------------


def events_source(spark: SparkSession, sf: str, kind: str = "plain") -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    key, value = F.col("user_id").cast("string"), F.col("props")
    if kind == "tombstoned":
        value = F.when(F.col("event_type") == "error", "").otherwise(value)
    if kind in ("keyless", "mixed"):
        key = F.when(F.col("event_type") != "view", key)
    if kind == "mixed":
        value = F.when(F.col("event_type") == "error", "").otherwise(value)
    return e.select(F.lit("events").alias("topic"), "event_id", "ts", core.epoch_ms(F.col("ts")).alias("timestamp_ms"), key.cast("binary").alias("key"), value.cast("binary").alias("value"))


def events_log(spark: SparkSession, sf: str, kind: str = "plain") -> DataFrame:
    order = ["ts", "event_id"]
    routed = log.route(events_source(spark, sf, kind), PARTITIONS, order)
    return log.assign_offsets(routed, order, keys=KEYS).select("topic", "partition", "offset", "timestamp_ms", "key", "value")


def rolled_log(spark: SparkSession, sf: str, kind: str = "plain", partition: int | None = None) -> DataFrame:
    """The segments of all partitions or of one: a partition rolls by itself, so the others needn't be ordered for it."""
    built = events_log(spark, sf, kind)
    return segments.roll(built if partition is None else built.where(F.col("partition") == partition), SEGMENT_BYTES, KEYS)


def segment_stats(spark: SparkSession, sf: str, kind: str = "plain") -> DataFrame:
    return segments.stats(rolled_log(spark, sf, kind), KEYS)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


COMMITS = [("g1", "events", 0, 10, 1), ("g1", "events", 1, 50, 2), ("g1", "events", 0, 120, 3), ("g2", "events", 2, 1_000_000, 4), ("g2", "events", 0, 90, 5), ("g2", "events", 0, 30, 6), ("g3", "gone", 0, 5, 7), ("g3", "events", 9, 5, 8)]
NAMES = ["orders", "orders.eu", "ordersecret", "orders-archive", "acme-corp", "acme", "billing_v1", "billing.x", "events"]
ACLS = [("k1", "read", "orders"), ("k2", "write", "acme-"), ("k3", "admin", "*"), ("k4", "read", "billing_"), ("k4", "write", "events"), ("k5", "read", "")]
CONFIGS = [("a", 4, None, None, None, None, None), ("b", 8, 1000, None, "compact", 4096, None), ("c", 1, None, 500, "compact,delete", None, 77)]
SCHEMAS = [
    (1, "user-value", "json_schema", '{"properties":{"name":{},"age":{}},"required":["name"]}', 1),
    (2, "user-value", "json_schema", '{"properties":{"name":{}},"required":["name"]}', 2),
    (3, "user-value", "json_schema", '{"properties":{"name":{},"age":{},"x":{}},"required":["name"]}', 3),
    (4, "order-key", "json_schema", '{"properties":{"id":{}}}', 4),
    (5, "order-key", "json_schema", '{"properties":{"id":{}},"required":["id"]}', 5),
]
QUOTA = [("a", 0, 1, 600), ("a", 100, 2, 600), ("a", 1000, 3, 600), ("a", 1000, 4, 1200), ("a", 3000, 5, 1000), ("b", 0, 1, 5), ("b", 1, 2, 7), ("c", 500, 1, 99)]
RATES = [("a", 1000), ("b", 10)]
HEARTBEATS = [("m1", 100_000), ("m1", 90_000), ("m2", 85_000), ("m3", 84_999), ("m4", 10)]
MEMBERS = ["a", "b", "c"]
SEQUENCES = [("p1", 0, 42), ("p1", 0, 43), ("p1", 0, 43), ("p1", 0, 45), ("p1", 0, 44), ("p1", 0, 41), ("p1", 1, 0), ("p1", 1, 1), ("p1", 1, 0), ("p2", 0, 7), ("p2", 0, 6), ("p2", 0, 8)]
REQUESTS = [("events", None, None, "v", None, None), ("events", 9, None, "v", None, None), ("events", 1, "p1", "v", None, None), ("events", 1, "p1", "v", -1, None), ("events", 1, "bad id", "v", 1, None), ("nope", 1, None, "v", None, None), ("secret", 1, None, "v", None, None), ("events", 3, "p1", "v", 3, "k")]


# --- SQL ----------------------------------------------------------------------------------------------------------

FNV = "list_reduce([14695981039346656037::HUGEINT] || list_transform(range(0, octet_length(encode({k}))::BIGINT), lambda i: ('0x' || substr(hex(encode({k})), (2*i+1)::BIGINT, 2))::HUGEINT), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"


def sql_log(kind: str = "plain") -> str:
    key = "CAST(user_id AS VARCHAR)" if kind in ("plain", "tombstoned") else "CASE WHEN event_type <> 'view' THEN CAST(user_id AS VARCHAR) END"
    value = "props" if kind in ("plain", "keyless") else "CASE WHEN event_type = 'error' THEN '' ELSE props END"
    return f"""src AS (SELECT event_id, ts, epoch_us(ts) // 1000 AS timestamp_ms, {key} AS key, {value} AS value FROM events),
    keyset AS (SELECT key, CAST({FNV.format(k="key")} % {PARTITIONS} AS INTEGER) AS p FROM (SELECT DISTINCT key FROM src WHERE key IS NOT NULL)),
    routed AS (SELECT src.*, CASE WHEN src.key IS NOT NULL THEN keyset.p ELSE CAST((row_number() OVER (PARTITION BY src.key IS NULL ORDER BY ts, event_id) - 1) % {PARTITIONS} AS INTEGER) END AS partition FROM src LEFT JOIN keyset ON src.key = keyset.key),
    log AS (SELECT 'events' AS topic, partition, row_number() OVER (PARTITION BY partition ORDER BY ts, event_id) - 1 AS "offset", timestamp_ms, key, value,
        CAST(32 + coalesce(octet_length(encode(key)), 0) + octet_length(encode(value)) AS BIGINT) AS size FROM routed)"""


#: The roll, record by record: every partition advances one offset a step.
SQL_ROLL = f"""fold AS (SELECT partition, "offset" AS o, "offset" AS base, size AS cur FROM log WHERE "offset" = 0
    UNION ALL SELECT l.partition, l."offset", CASE WHEN f.cur + l.size > {SEGMENT_BYTES} THEN l."offset" ELSE f.base END, CASE WHEN f.cur + l.size > {SEGMENT_BYTES} THEN l.size ELSE f.cur + l.size END
    FROM fold f JOIN log l ON l.partition = f.partition AND l."offset" = f.o + 1),
    rolled AS (SELECT log.*, fold.base AS segment_base FROM log JOIN fold ON log.partition = fold.partition AND log."offset" = fold.o)"""
SQL_SEGMENTS = """segs AS (SELECT partition, segment_base, max("offset") + 1 AS end_offset, CAST(sum(size) AS BIGINT) AS size_bytes, count(*) AS record_count, min(timestamp_ms) AS min_ts, max(timestamp_ms) AS max_ts,
    segment_base = max(segment_base) OVER (PARTITION BY partition) AS is_active FROM rolled GROUP BY partition, segment_base)"""


def sql(body: str, kind: str = "plain", roll: bool = False, segs: bool = False) -> str:
    parts = [sql_log(kind), *([SQL_ROLL] if roll or segs else []), *([SQL_SEGMENTS] if segs else [])]
    return f"WITH RECURSIVE {', '.join(parts)}{body}" if body.lstrip().startswith(",") else f"WITH RECURSIVE {', '.join(parts)} {body}"


def literal(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def sql_values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)})"


RETENTION_MS, RETENTION_BYTES = 20 * DAY, 60_000


def sql_plan(by_time: bool, by_size: bool) -> str:
    time = f"max_ts < {NOW_MS - RETENTION_MS}" if by_time else "false"
    size = f"(total - {RETENTION_BYTES} > 0 AND before < total - {RETENTION_BYTES})" if by_size else "false"
    return f""", sized AS (SELECT *, coalesce(sum(size_bytes) OVER (PARTITION BY partition ORDER BY segment_base ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size_bytes) OVER (PARTITION BY partition) AS total, count(*) OVER (PARTITION BY partition) AS n FROM segs),
    plan AS (SELECT *, NOT is_active AND n >= 2 AND ({time} OR {size}) AS victim FROM sized)"""


SQL_MARKS = f""", act AS (SELECT partition, max(segment_base) AS a FROM rolled GROUP BY partition),
    sealed AS (SELECT rolled.*, segment_base < a AS sealed FROM rolled JOIN act USING (partition)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY partition, sealed, key ORDER BY "offset" DESC) AS r FROM sealed),
    marks AS (SELECT *, NOT sealed OR key IS NULL OR (r = 1 AND NOT (value = '' AND timestamp_ms < {NOW_MS - 10 * DAY})) AS keep FROM ranked)"""

ACL_SQL = "(CASE WHEN a.prefix = '*' THEN true WHEN a.prefix = '' THEN false ELSE starts_with(n.name, a.prefix) AND (length(n.name) = length(a.prefix) OR right(a.prefix, 1) IN ('.', '-', '_') OR substr(n.name, length(a.prefix) + 1, 1) = '.') END)"
IMPLIES_SQL = "(a.action = w.action OR a.action = 'admin' OR (a.action = 'write' AND w.action = 'read'))"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


# --- queries ------------------------------------------------------------------------------------------------------


@query(sql('SELECT topic, partition, "offset", timestamp_ms, key, value, size FROM log'))
def q01_log_build(spark, sf):
    return events_log(spark, sf).select("topic", "partition", "offset", "timestamp_ms", text("key"), text("value"), core.disk_size(F.col("key"), F.col("value")).alias("size"))


@query(sql("SELECT partition, count(*) AS records, CAST(sum(size - 32) AS BIGINT) AS payload_bytes FROM log GROUP BY partition"))
def q02_route_histogram(spark, sf):
    return events_log(spark, sf).groupBy("partition").agg(F.count("*").alias("records"), F.sum(core.payload_bytes(F.col("key"), F.col("value"))).cast("long").alias("payload_bytes"))


@query(sql('SELECT partition, "offset", key, timestamp_ms FROM log', "keyless"))
def q03_route_round_robin(spark, sf):
    return events_log(spark, sf, "keyless").select("partition", "offset", text("key"), "timestamp_ms")


@query(
    f"""WITH s AS (SELECT event_id, ts, CASE WHEN event_id % 5 = 0 THEN CAST(event_id % {PARTITIONS} AS INTEGER) END AS hint, CASE WHEN event_type <> 'view' THEN CAST(user_id AS VARCHAR) END AS key FROM events),
    k AS (SELECT key, CAST({FNV.format(k="key")} % {PARTITIONS} AS INTEGER) AS p FROM (SELECT DISTINCT key FROM s WHERE key IS NOT NULL))
    SELECT event_id, CASE WHEN hint IS NOT NULL THEN hint WHEN s.key IS NOT NULL THEN p ELSE CAST((row_number() OVER (PARTITION BY hint IS NULL AND s.key IS NULL ORDER BY ts, event_id) - 1) % {PARTITIONS} AS INTEGER) END AS partition FROM s LEFT JOIN k ON s.key = k.key"""
)
def q04_route_hint_precedence(spark, sf):
    source = events_source(spark, sf, "keyless").withColumn("hint", F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % PARTITIONS).cast("int")))
    return log.route(source, PARTITIONS, ["ts", "event_id"]).select("event_id", "partition")


@query(sql(', base AS (SELECT min(segment_base) AS b FROM (SELECT segment_base FROM rolled WHERE partition = 0 AND "offset" >= 100 ORDER BY "offset" LIMIT 1)) SELECT "offset", timestamp_ms, key, value FROM rolled, base WHERE partition = 0 AND "offset" >= 100 AND segment_base = b ORDER BY "offset" LIMIT 50', roll=True))
def q05_fetch_records(spark, sf):
    return consume.fetch(rolled_log(spark, sf, partition=0), 0, 100, max_records=50).select("offset", "timestamp_ms", text("key"), text("value"))


@query(
    sql(
        ', f AS (SELECT *, row_number() OVER (ORDER BY "offset") AS rn, sum(size) OVER (ORDER BY "offset") AS run, first(segment_base) OVER (ORDER BY "offset") AS b FROM rolled WHERE partition = 1 AND "offset" >= 7) SELECT "offset", key, value FROM f WHERE segment_base = b AND rn <= 1000 AND (rn = 1 OR run <= 1500)',
        roll=True,
    )
)
def q06_fetch_bytes(spark, sf):
    return consume.fetch(rolled_log(spark, sf, partition=1), 1, 7, max_records=1000, max_bytes=1500).select("offset", text("key"), text("value"))


@query(
    sql(
        """, pf AS (SELECT partition, "offset" AS o, segment_base AS sb, 0::BIGINT AS page, 1 AS cnt, size AS cur FROM rolled WHERE "offset" = 0
    UNION ALL SELECT l.partition, l."offset", l.segment_base, CASE WHEN l.segment_base <> f.sb OR f.cnt = 20 OR f.cur + l.size > 1000 THEN f.page + 1 ELSE f.page END, CASE WHEN l.segment_base <> f.sb OR f.cnt = 20 OR f.cur + l.size > 1000 THEN 1 ELSE f.cnt + 1 END, CASE WHEN l.segment_base <> f.sb OR f.cnt = 20 OR f.cur + l.size > 1000 THEN l.size ELSE f.cur + l.size END
    FROM pf f JOIN rolled l ON l.partition = f.partition AND l."offset" = f.o + 1)
    SELECT p.partition, page, min(o) AS first_offset, max(o) + 1 AS next_offset, count(*) AS records, CAST(sum(l.size) AS BIGINT) AS bytes FROM pf p JOIN log l ON l.partition = p.partition AND l."offset" = p.o GROUP BY p.partition, page""",
        roll=True,
    )
)
def q07_fetch_pages(spark, sf):
    return consume.pages(rolled_log(spark, sf), 20, 1000, KEYS).drop("topic")


@query(sql('SELECT partition, "offset", to_base64(encode(key)) AS key, to_base64(encode(value)) AS value FROM log', "tombstoned"))
def q08_payload_base64(spark, sf):
    return consume.encode(events_log(spark, sf, "tombstoned"), "base64").select("partition", "offset", "key", "value")


def _ends(spark, sf):
    return segments.describe(segment_stats(spark, sf), KEYS)


SQL_ENDS = ', ends AS (SELECT partition, min("offset") AS start_offset, max("offset") + 1 AS end_offset FROM log GROUP BY partition)'
SQL_COMMITS = ", " + sql_values("commits", 'grp, topic, partition, "offset", commit_seq', COMMITS) + ', latest AS (SELECT grp, topic, partition, arg_max("offset", commit_seq) AS "offset" FROM commits GROUP BY ALL)'


def _commits(spark):
    return values(spark, COMMITS, "`group` string, topic string, partition int, offset long, commit_seq long")


@query(sql(f"""{SQL_ENDS}{SQL_COMMITS} SELECT e.partition, CAST(coalesce(l."offset", start_offset) AS BIGINT) AS position FROM ends e LEFT JOIN latest l ON l.grp = 'g1' AND l.topic = 'events' AND l.partition = e.partition"""))
def q09_group_consume(spark, sf):
    return consume.group_start(_ends(spark, sf), groups.latest_commits(_commits(spark)), "g1").select("partition", F.col("position").cast("long").alias("position"))


@query(f"""WITH x AS (SELECT 1){SQL_COMMITS} SELECT grp AS "group", topic, CAST(partition AS INTEGER) AS partition, CAST("offset" AS BIGINT) AS "offset" FROM latest""")
def q10_commit_latest(spark, sf):
    return groups.latest_commits(_commits(spark)).select("group", "topic", "partition", "offset")


@query(sql(f"""{SQL_ENDS}{SQL_COMMITS} SELECT grp AS "group", CAST(l.partition AS INTEGER) AS partition, CAST(l."offset" AS BIGINT) AS "offset", CAST(greatest(end_offset - l."offset", 0) AS BIGINT) AS lag FROM latest l JOIN ends e ON l.topic = 'events' AND l.partition = e.partition"""))
def q11_group_lag(spark, sf):
    return groups.lag(_commits(spark), _ends(spark, sf)).select("group", "partition", "offset", "lag")


@query(sql(f"""{SQL_ENDS}{SQL_COMMITS} SELECT count(DISTINCT grp) AS groups, count(*) AS entries FROM latest l JOIN ends e ON l.topic = 'events' AND l.partition = e.partition"""))
def q12_reset_offsets(spark, sf):
    return groups.reset(_commits(spark), _ends(spark, sf), "events")[1]


@query(sql("SELECT * FROM segs", segs=True))
def q13_segment_roll(spark, sf):
    return segment_stats(spark, sf).drop("topic")


@query(sql("SELECT partition, min(segment_base) AS start_offset, max(end_offset) AS end_offset, count(*) AS segment_count, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM segs GROUP BY partition", segs=True))
def q14_describe_topic(spark, sf):
    return segments.describe(segment_stats(spark, sf), KEYS).drop("topic")


SQL_INDEX = """, pos AS (SELECT partition, segment_base, "offset", CAST(coalesce(sum(size) OVER (PARTITION BY partition, segment_base ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS file_pos FROM rolled),
    idx AS (SELECT partition, segment_base, segment_base AS o, 0::BIGINT AS last, 0::BIGINT AS file_pos, true AS hit FROM pos WHERE "offset" = segment_base
    UNION ALL SELECT p.partition, p.segment_base, p."offset", CASE WHEN p.file_pos >= i.last + 1024 THEN p.file_pos ELSE i.last END, p.file_pos, p.file_pos >= i.last + 1024 FROM idx i JOIN pos p ON p.partition = i.partition AND p.segment_base = i.segment_base AND p."offset" = i.o + 1),
    entries AS (SELECT partition, segment_base, o - segment_base AS relative_offset, file_pos FROM idx WHERE hit)"""


@query(sql(f"{SQL_INDEX} SELECT * FROM entries", roll=True))
def q15_sparse_index(spark, sf):
    return segments.sparse_index(rolled_log(spark, sf), 1024, KEYS).drop("topic")


@query(sql(f"""{SQL_INDEX}, targets AS (SELECT partition, "offset" AS target FROM log) SELECT t.partition, t.target, e.segment_base, e.relative_offset, e.file_pos FROM targets t ASOF JOIN (SELECT *, segment_base + relative_offset AS at FROM entries) e ON t.partition = e.partition AND t.target >= e.at""", roll=True))
def q16_index_floor(spark, sf):
    rolled = rolled_log(spark, sf)
    targets = rolled.select("topic", "partition", F.col("offset").alias("target"))
    return segments.index_floor(targets, segments.sparse_index(rolled, 1024, KEYS), KEYS).drop("topic")


def _plan(spark, sf, by_time: bool, by_size: bool):
    return maintain.retention_plan(segment_stats(spark, sf), NOW_MS, RETENTION_MS if by_time else None, RETENTION_BYTES if by_size else None, KEYS)


@query(sql(f"{sql_plan(True, False)} SELECT partition, segment_base, size_bytes, victim FROM plan", segs=True))
def q17_retention_time(spark, sf):
    return _plan(spark, sf, True, False).select("partition", "segment_base", "size_bytes", "victim")


@query(sql(f"{sql_plan(False, True)} SELECT partition, segment_base, size_bytes, victim FROM plan", segs=True))
def q18_retention_size(spark, sf):
    return _plan(spark, sf, False, True).select("partition", "segment_base", "size_bytes", "victim")


@query(sql(f"{sql_plan(True, True)} SELECT partition, min(segment_base) FILTER (NOT victim) AS start_offset, count(*) FILTER (victim) AS segments_deleted, CAST(coalesce(sum(size_bytes) FILTER (victim), 0) AS BIGINT) AS bytes_reclaimed FROM plan GROUP BY partition", segs=True))
def q19_retention_both(spark, sf):
    return maintain.retention_report(_plan(spark, sf, True, True), KEYS).drop("topic")


@query(sql(f"{SQL_MARKS.replace(str(NOW_MS - 10 * DAY), '0')} SELECT partition, \"offset\", key, value FROM marks WHERE keep", "keyless", roll=True))
def q20_compact_latest(spark, sf):
    return maintain.compaction_marks(rolled_log(spark, sf, "keyless"), 0, 0, KEYS).where("keep").select("partition", "offset", text("key"), text("value"))


@query(sql(f"{SQL_MARKS} SELECT partition, \"offset\", key, value, timestamp_ms FROM marks WHERE keep", "mixed", roll=True))
def q21_compact_tombstones(spark, sf):
    return maintain.compaction_marks(rolled_log(spark, sf, "mixed"), NOW_MS, 10 * DAY, KEYS).where("keep").select("partition", "offset", text("key"), text("value"), "timestamp_ms")


@query(sql(f"{SQL_MARKS} SELECT partition, count(*) FILTER (sealed AND keep) AS kept, count(*) FILTER (sealed AND NOT keep) AS dropped, CASE WHEN count(*) FILTER (sealed AND NOT keep) > 0 THEN count(DISTINCT segment_base) FILTER (sealed) ELSE 0 END AS sealed_merged FROM marks GROUP BY partition", "mixed", roll=True))
def q22_compact_report(spark, sf):
    return maintain.compaction_report(maintain.compaction_marks(rolled_log(spark, sf, "mixed"), NOW_MS, 10 * DAY, KEYS), KEYS).drop("topic")


@query(
    sql(
        f"""{SQL_MARKS}, low AS (SELECT partition, min(segment_base) AS lowest, bool_or(NOT keep) AS changed FROM marks GROUP BY partition),
    merged AS (SELECT m.partition, "offset", key, value, timestamp_ms, size, CASE WHEN sealed AND changed THEN lowest ELSE segment_base END AS segment_base FROM marks m JOIN low USING (partition) WHERE keep),
    segs2 AS (SELECT partition, segment_base, sum(size) AS size_bytes, max(timestamp_ms) AS max_ts FROM merged GROUP BY ALL),
    plan2 AS (SELECT *, segment_base < max(segment_base) OVER (PARTITION BY partition) AND max_ts < {NOW_MS - 2 * DAY} AS victim FROM segs2)
    SELECT m.partition, m."offset", m.segment_base, m.key FROM merged m JOIN plan2 p ON m.partition = p.partition AND m.segment_base = p.segment_base WHERE NOT victim""",
        "mixed",
        roll=True,
    )
)
def q23_compact_delete(spark, sf):
    out = maintain.run_policy(rolled_log(spark, sf, "mixed"), "compact,delete", NOW_MS, 2 * DAY, None, 10 * DAY, KEYS)
    return out.select("partition", "offset", "segment_base", text("key"))


@query(sql(f"{sql_plan(True, True)} SELECT partition, segment_base, lpad(CAST(segment_base AS VARCHAR), 20, '0') AS file FROM plan WHERE victim", segs=True))
def q24_cold_bases(spark, sf):
    return _plan(spark, sf, True, True).where("victim").select("partition", "segment_base", core.segment_file(F.col("segment_base")).alias("file")).orderBy("partition", "segment_base")


def _retried(spark, sf):
    """Each event_id divisible by 7 is sent twice; sequences are those of the first sending."""
    order = ["ts", "event_id"]
    source = log.route(events_source(spark, sf), PARTITIONS, order).withColumn("producer_id", F.concat(F.lit("p"), (F.col("key").cast("string").cast("long") % 10).cast("string")))
    # A fold carries every column it is given, and no query of these needs keys and values.
    numbered = source.drop("key", "value").withColumn("sequence", F.row_number().over(Window.partitionBy("producer_id", "partition").orderBy(*order)).cast("long") - 1)
    attempts = F.when(F.col("event_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return numbered.withColumn("attempt", F.explode(attempts)).withColumn("mark", F.col("event_id") * 2 + F.col("attempt"))


ARRIVAL = ["ts", "event_id", "attempt"]
SQL_RETRIED = """, numbered AS (SELECT *, 'p' || CAST(CAST(key AS BIGINT) % 10 AS VARCHAR) AS producer_id FROM routed),
    seqd AS (SELECT *, row_number() OVER (PARTITION BY producer_id, partition ORDER BY ts, event_id) - 1 AS sequence FROM numbered),
    sent AS (SELECT *, 0 AS attempt FROM seqd UNION ALL SELECT *, 1 AS attempt FROM seqd WHERE event_id % 7 = 0)"""


@query(sql(f"""{SQL_RETRIED} SELECT s.producer_id, s.partition, s.sequence, l."offset", s.attempt = 1 AS duplicate FROM sent s JOIN (SELECT event_id, row_number() OVER (PARTITION BY partition ORDER BY ts, event_id) - 1 AS "offset" FROM routed) l USING (event_id)"""))
def q25_dedupe_retries(spark, sf):
    done = idempotent.with_offsets(idempotent.classify(_retried(spark, sf), ARRIVAL, "mark"), ARRIVAL, "mark")
    return done.select("producer_id", "partition", "sequence", "offset", "duplicate")


@query(
    f"""WITH RECURSIVE {sql_values("raw", "producer_id, partition, sequence", SEQUENCES)}, numbered AS (SELECT *, row_number() OVER () AS arrival FROM raw),
    stream AS (SELECT *, row_number() OVER (PARTITION BY producer_id, partition ORDER BY arrival) AS i FROM numbered),
    run AS (SELECT producer_id, partition, i, arrival, sequence, sequence AS last, sequence AS first, 'accept' AS outcome FROM stream WHERE i = 1
      UNION ALL SELECT s.producer_id, s.partition, s.i, s.arrival, s.sequence, CASE WHEN s.sequence = r.last + 1 THEN s.sequence ELSE r.last END, r.first,
        CASE WHEN s.sequence = r.last + 1 THEN 'accept' WHEN s.sequence > r.last + 1 THEN 'gap' WHEN s.sequence >= r.first AND s.sequence > r.last - 128 THEN 'duplicate' ELSE 'too_low' END
        FROM run r JOIN stream s ON s.producer_id = r.producer_id AND s.partition = r.partition AND s.i = r.i + 1)
    SELECT producer_id, CAST(partition AS INTEGER) AS partition, CAST(arrival AS BIGINT) AS arrival, CAST(sequence AS BIGINT) AS sequence, outcome FROM run"""
)
def q26_dedupe_classify(spark, sf):
    rows = values(spark, [(*r, i + 1) for i, r in enumerate(SEQUENCES)], "producer_id string, partition int, sequence long, arrival long")
    return idempotent.classify(rows, ["arrival"], "arrival").select("producer_id", "partition", "arrival", "sequence", "outcome")


@query(sql(f"""{SQL_RETRIED} SELECT producer_id, s.partition, max(sequence) AS last_seen, arg_max(l."offset", sequence) AS last_offset, max(s.timestamp_ms) AS last_used_ms, least(count(*), 128) AS window_size FROM seqd s JOIN (SELECT event_id, row_number() OVER (PARTITION BY partition ORDER BY ts, event_id) - 1 AS "offset" FROM routed) l USING (event_id) GROUP BY ALL"""))
def q27_producer_state(spark, sf):
    done = idempotent.with_offsets(idempotent.classify(_retried(spark, sf), ARRIVAL, "mark"), ARRIVAL, "mark")
    return idempotent.producer_state(done).select("producer_id", "partition", "last_seen", "last_offset", "last_used_ms", F.size("recent").cast("long").alias("window_size"))


STATES = [("p1", 0, 5, 9, NOW_MS), ("p2", 0, 5, 9, NOW_MS - 7 * DAY), ("p3", 0, 5, 9, NOW_MS - 7 * DAY - 1)]


@query(f"WITH {sql_values('s', 'producer_id, partition, last_seen, last_offset, last_used_ms', STATES)} SELECT producer_id, CAST(last_used_ms AS BIGINT) AS last_used_ms FROM s WHERE last_used_ms >= {NOW_MS - 7 * DAY}")
def q28_producer_expiry(spark, sf):
    return idempotent.expire(values(spark, STATES, "producer_id string, partition int, last_seen long, last_offset long, last_used_ms long"), NOW_MS).select("producer_id", "last_used_ms")


def _assignment(spark, got: dict):
    return values(spark, [(m, t, p) for m, pairs in got.items() for t, p in pairs], "member_id string, topic string, partition int")


@query("WITH p AS (SELECT unnest(range(0, 7)) AS partition) SELECT ['a', 'b', 'c'][CAST((row_number() OVER (ORDER BY partition) - 1) % 3 + 1 AS BIGINT)] AS member_id, 'events' AS topic, CAST(partition AS INTEGER) AS partition FROM p")
def q29_assign_initial(spark, sf):
    return _assignment(spark, coord.assign({m: ["events"] for m in MEMBERS}, {"events": 7}))


@query(
    """WITH p AS (SELECT unnest(range(0, 6)) AS partition), before AS (SELECT partition, ['a', 'b'][partition % 2 + 1] AS m FROM p),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY partition) AS k FROM before), fair AS (SELECT CAST(ceil(count(*) / 3.0) AS BIGINT) AS share FROM p)
    SELECT CASE WHEN k <= share THEN m ELSE 'c' END AS member_id, 'events' AS topic, CAST(partition AS INTEGER) AS partition FROM ranked, fair"""
)
def q30_assign_sticky(spark, sf):
    before = coord.assign({m: ["events"] for m in "ab"}, {"events": 6})
    return _assignment(spark, coord.assign({m: ["events"] for m in MEMBERS}, {"events": 6}, before))


@query(f"WITH {sql_values('h', 'member_id, beat', HEARTBEATS)} SELECT member_id, CAST(max(beat) AS BIGINT) AS last_heartbeat_ms FROM h GROUP BY 1 HAVING 100000 - max(beat) > 15000")
def q31_member_expiry(spark, sf):
    h = values(spark, HEARTBEATS, "member_id string, at long").groupBy("member_id").agg(F.max("at").alias("last_heartbeat_ms"))
    return h.where(100_000 - F.col("last_heartbeat_ms") > 15_000)


def _acls(spark):
    return values(spark, [(*a, False) for a in ACLS], "key_id string, action string, topic_prefix string, disabled boolean")


def _asked(spark):
    return values(spark, [(k, a, n) for k in ("k1", "k2", "k3", "k4", "k5") for a in ("read", "write", "admin") for n in NAMES], "key_id string, action string, name string")


SQL_ACL = f"{sql_values('a', 'key_id, action, prefix', ACLS)}, {sql_values('n', 'name', [(x,) for x in NAMES])}, k(key_id) AS (VALUES ('k1'), ('k2'), ('k3'), ('k4'), ('k5'))"


@query(f"WITH {SQL_ACL}, w(action) AS (VALUES ('read'), ('write'), ('admin')) SELECT k.key_id, w.action, n.name, EXISTS (SELECT 1 FROM a WHERE a.key_id = k.key_id AND {IMPLIES_SQL} AND {ACL_SQL}) AS allowed FROM k, w, n")
def q32_acl_matrix(spark, sf):
    return auth.can(_asked(spark), _acls(spark))


@query(f"WITH {SQL_ACL}, w(action) AS (VALUES ('read')) SELECT n.name FROM n, w WHERE EXISTS (SELECT 1 FROM a WHERE a.key_id = 'k4' AND {IMPLIES_SQL} AND {ACL_SQL})")
def q33_acl_visible(spark, sf):
    return auth.visible(values(spark, [(n,) for n in NAMES], "name string"), _acls(spark), "k4")


@query(f"WITH {SQL_ACL} SELECT k.key_id, n.name, EXISTS (SELECT 1 FROM a WHERE a.key_id = k.key_id AND ({ACL_SQL} OR (a.action = 'admin' AND a.prefix = '*'))) AS may_claim FROM k, n")
def q34_may_claim(spark, sf):
    return auth.may_claim(_asked(spark).select("key_id", "name").distinct(), _acls(spark))


@query(
    f"""WITH RECURSIVE {sql_values("q", "key_id, t_ms, seq, bytes", QUOTA)}, {sql_values("r", "key_id, rate", RATES)}, s AS (SELECT q.*, r.rate FROM q LEFT JOIN r USING (key_id)),
    f AS (SELECT key_id, seq, t_ms, bytes, rate, rate IS NULL OR bytes <= rate AS granted, CASE WHEN rate IS NULL THEN 0.0::DOUBLE WHEN bytes <= rate THEN rate::DOUBLE - bytes ELSE rate::DOUBLE END AS tokens, CASE WHEN bytes > rate THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS retry_s FROM s WHERE seq = 1
    UNION ALL SELECT s.key_id, s.seq, s.t_ms, s.bytes, s.rate, s.rate IS NULL OR (s.bytes <= s.rate AND s.bytes <= m.have), CASE WHEN s.rate IS NULL THEN 0.0::DOUBLE WHEN s.bytes <= s.rate AND s.bytes <= m.have THEN m.have - s.bytes ELSE m.have END, CASE WHEN s.rate IS NULL THEN 0.0::DOUBLE WHEN s.bytes > s.rate THEN 1.0::DOUBLE WHEN s.bytes > m.have THEN (s.bytes - m.have) / s.rate ELSE 0.0::DOUBLE END
    FROM f JOIN s ON s.key_id = f.key_id AND s.seq = f.seq + 1, LATERAL (SELECT least(s.rate::DOUBLE, f.tokens + (s.t_ms - f.t_ms) / 1000.0::DOUBLE * s.rate) AS have) m)
    SELECT key_id, CAST(seq AS BIGINT) AS seq, granted, round(tokens, 6) AS tokens, round(retry_s, 6) AS retry_s FROM f"""
)
def q35_quota_fold(spark, sf):
    got = auth.produce_quota(values(spark, QUOTA, "key_id string, t_ms long, seq long, bytes long"), values(spark, RATES, "key_id string, rate long"))
    return got.select("key_id", "seq", "granted", F.round("tokens", 6).alias("tokens"), F.round("retry_s", 6).alias("retry_s"))


@query(
    sql(
        f"""{SQL_COMMITS}, d AS (SELECT partition, min(segment_base) AS start_offset, max(end_offset) AS end_offset, count(*) AS segment_count, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM segs GROUP BY partition),
    g AS (SELECT l.grp, l.partition, l."offset" AS o, greatest(end_offset - l."offset", 0) AS lag FROM latest l JOIN d ON l.topic = 'events' AND l.partition = d.partition)
    SELECT 'es_partition_start_offset{{topic="events",partition="' || partition || '"}} ' || start_offset AS line FROM d UNION ALL SELECT 'es_partition_end_offset{{topic="events",partition="' || partition || '"}} ' || end_offset FROM d
    UNION ALL SELECT 'es_partition_size_bytes{{topic="events",partition="' || partition || '"}} ' || size_bytes FROM d UNION ALL SELECT 'es_partition_segment_count{{topic="events",partition="' || partition || '"}} ' || segment_count FROM d
    UNION ALL SELECT 'es_group_committed_offset{{group="' || grp || '",topic="events",partition="' || partition || '"}} ' || o FROM g UNION ALL SELECT 'es_group_lag{{group="' || grp || '",topic="events",partition="' || partition || '"}} ' || lag FROM g
    UNION ALL SELECT 'es_topic_records_produced_total{{topic="events"}} ' || count(*) FROM log UNION ALL SELECT 'es_topic_bytes_produced_total{{topic="events"}} ' || CAST(sum(size - 32) AS BIGINT) FROM log""",
        segs=True,
    )
)
def q36_metrics_long(spark, sf):
    described = segments.describe(segment_stats(spark, sf), KEYS)
    long = metrics.union(metrics.partitions(described), metrics.groups(groups.lag(_commits(spark), described)), metrics.topics(metrics.produced(events_log(spark, sf))))
    return long.select(metrics.exposition(F.col("metric"), F.col("labels"), F.col("value")).alias("line"))


SQL_SCHEMAS = sql_values("s", "id, subject, type, schema, created_at_ms", SCHEMAS)


@query(
    f"""WITH {SQL_SCHEMAS}, f AS (SELECT id, subject, coalesce(CAST(json_extract(schema, '$.required') AS VARCHAR[]), []) AS req, json_keys(json_extract(schema, '$.properties')) AS props FROM s)
    SELECT CAST(o.id AS INTEGER) AS old_id, CAST(n.id AS INTEGER) AS new_id, len(list_filter(n.req, lambda x: NOT list_contains(o.req, x))) = 0 AND len(list_filter(o.props, lambda x: NOT list_contains(n.props, x))) = 0 AS compatible FROM f o JOIN f n ON o.subject = n.subject AND o.id < n.id"""
)
def q37_schema_compat(spark, sf):
    s = values(spark, SCHEMAS, "id int, subject string, type string, schema string, created_at_ms long")
    old, new = s.select(F.col("id").alias("old_id"), "subject", F.col("schema").alias("old")), s.select(F.col("id").alias("new_id"), "subject", F.col("schema").alias("new"))
    return old.join(new, "subject").where("old_id < new_id").select("old_id", "new_id", registry.compatible(F.col("old"), F.col("new")).alias("compatible"))


@query(f"WITH {SQL_SCHEMAS} SELECT subject, CAST(max(id) AS INTEGER) AS id, arg_max(schema, id) AS schema FROM s GROUP BY 1")
def q38_schema_latest(spark, sf):
    return registry.latest(values(spark, SCHEMAS, "id int, subject string, type string, schema string, created_at_ms long")).select("subject", "id", "schema")


@query(
    f"WITH {sql_values('c', 'name, partitions, retention_ms, retention_bytes, cleanup_policy, segment_bytes, tombstone_retention_ms', CONFIGS)} SELECT name, CAST(CASE WHEN name = 'b' THEN coalesce(2000, retention_ms) ELSE retention_ms END AS BIGINT) AS retention_ms, CAST(coalesce(retention_bytes, 10000) AS BIGINT) AS retention_bytes, coalesce(cleanup_policy, 'delete') AS cleanup_policy, CAST(coalesce(segment_bytes, {64 << 20}) AS BIGINT) AS segment_bytes, CAST(coalesce(tombstone_retention_ms, 86400000) AS BIGINT) AS tombstone_retention_ms FROM c"
)
def q39_config_resolve(spark, sf):
    from ..model import TOPIC_CATALOG

    topics = catalog.patch(spark.createDataFrame(CONFIGS, TOPIC_CATALOG), "b", retention_ms=2000)
    return catalog.resolved(topics, {"retention_bytes": 10_000}).drop("partitions")


@query(f"""WITH x AS (SELECT 1){SQL_COMMITS} SELECT grp AS "group", topic, CAST(partition AS INTEGER) AS partition, CAST("offset" AS BIGINT) AS "offset" FROM commits WHERE topic <> 'gone'""")
def q40_purge_topic(spark, sf):
    return catalog.purge("gone", _commits(spark))[0].select("group", "topic", "partition", "offset")


@query(
    f"""WITH {sql_values("r", "topic, hint, producer_id, value, sequence, key", REQUESTS)} SELECT row_number() OVER () AS id, CASE WHEN topic = 'secret' THEN 'forbidden' WHEN topic = 'nope' THEN 'unknown_topic' WHEN producer_id IS NOT NULL AND NOT regexp_full_match(producer_id, '[A-Za-z0-9_.-]{{1,200}}') THEN 'bad_producer_id' WHEN producer_id IS NOT NULL AND sequence IS NULL THEN 'sequence_required' WHEN producer_id IS NOT NULL AND sequence < 0 THEN 'negative_sequence' WHEN hint < 0 OR hint >= 4 THEN 'partition_out_of_range' END AS error FROM r"""
)
def q41_validate_produce(spark, sf):
    rows = values(spark, [(i + 1, *r) for i, r in enumerate(REQUESTS)], "id long, topic string, hint int, producer_id string, value string, sequence long, key string")
    error = log.produce_error(F.lit(4), F.col("topic") != "secret", F.col("topic") != "nope", F.lit(1), F.lit(True), F.col("producer_id").isNotNull())
    return rows.select("id", error.alias("error"))


@query()
def q42_record_crc(spark, sf):
    from ..sources import codec

    return codec.with_record(events_log(spark, sf, "mixed")).select("partition", "offset", F.hex("record").alias("record_hex"), F.crc32(F.col("record")).alias("crc"))


@query(sql('SELECT topic, count(DISTINCT segment_base || \':\' || partition) AS file_count, count(*) AS records, CAST(sum(size) AS BIGINT) AS total_bytes, count(DISTINCT partition) AS partitions FROM rolled GROUP BY topic', roll=True))
def q43_dump_manifest(spark, sf):
    from ..sources import backup

    return backup.totals(rolled_log(spark, sf))


def _table_log(spark, sf, table: str, topic: str, key: str, value: str, ts, order: list[str], n: int) -> DataFrame:
    source = spark.read.parquet(f"{sf}/{table}.parquet").select(F.lit(topic).alias("topic"), ts.alias("timestamp_ms"), F.col(key).cast("string").cast("binary").alias("key"), F.col(value).cast("binary").alias("value"), *order)
    return log.assign_offsets(log.route(source, n, order), order, keys=KEYS)


ORDERS_SQL = f"""WITH k AS (SELECT DISTINCT o_custkey AS c, CAST(o_custkey AS VARCHAR) AS key FROM orders), p AS (SELECT c, key, CAST({FNV.format(k="key")} % 8 AS INTEGER) AS partition FROM k),
    log AS (SELECT partition, key, o_orderstatus AS value, epoch_us(o_orderdate) // 1000 AS timestamp_ms, row_number() OVER (PARTITION BY partition ORDER BY o_orderdate, o_orderkey) - 1 AS "offset" FROM orders JOIN p ON c = o_custkey)"""


@query(f'{ORDERS_SQL} SELECT partition, "offset", key, value, timestamp_ms FROM log')
def q44_orders_log(spark, sf):
    built = _table_log(spark, sf, "orders", "orders", "o_custkey", "o_orderstatus", core.epoch_ms(F.col("o_orderdate")), ["o_orderdate", "o_orderkey"], 8)
    return built.select("partition", "offset", text("key"), text("value"), "timestamp_ms")


@query(f"""WITH k AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS key FROM conversations), p AS (SELECT c, key, CAST({FNV.format(k="key")} % 2 AS INTEGER) AS partition FROM k),
    log AS (SELECT partition, key, text AS value, row_number() OVER (PARTITION BY partition ORDER BY conv_id, turn, role, text) - 1 AS "offset" FROM conversations JOIN p ON c = conv_id)
    SELECT partition, key, max("offset") AS "offset", arg_max(value, "offset") AS value FROM log GROUP BY partition, key""")
def q45_conversations_latest(spark, sf):
    built = _table_log(spark, sf, "conversations", "conversations", "conv_id", "text", F.col("turn") * 1000, ["conv_id", "turn", "role", "text"], 2)
    latest = built.groupBy("partition", "key").agg(F.max("offset").alias("offset"), F.max_by("value", "offset").alias("value"))
    return latest.select("partition", text("key"), "offset", text("value"))


@query(
    f"""WITH s AS (SELECT event_id, ts, event_id // 7 AS request_id, event_id % 50 = 0 AS bad, CASE WHEN event_type <> 'view' THEN CAST(user_id AS VARCHAR) END AS key FROM events),
    refused AS (SELECT DISTINCT request_id FROM s WHERE bad),
    k AS (SELECT key, CAST({FNV.format(k="key")} % {PARTITIONS} AS INTEGER) AS p FROM (SELECT DISTINCT key FROM s WHERE key IS NOT NULL)),
    taken AS (SELECT event_id, ts, CASE WHEN s.key IS NOT NULL THEN p ELSE CAST((row_number() OVER (PARTITION BY s.key IS NULL ORDER BY ts, event_id) - 1) % {PARTITIONS} AS INTEGER) END AS partition FROM s LEFT JOIN k ON s.key = k.key WHERE request_id NOT IN (SELECT request_id FROM refused))
    SELECT event_id, partition, row_number() OVER (PARTITION BY partition ORDER BY ts, event_id) - 1 AS "offset", CAST(NULL AS VARCHAR) AS error FROM taken
    UNION ALL SELECT event_id, NULL, NULL, 'partition_out_of_range' FROM s WHERE request_id IN (SELECT request_id FROM refused)"""
)
def q46_produce_requests(spark, sf):
    """Requests of seven events; one whose hint is out of range refuses its request."""
    from ..operators.produce import produce

    source = events_source(spark, sf, "keyless").withColumn("hint", F.when(F.col("event_id") % 50 == 0, 9)).withColumn("request_id", F.expr("event_id div 7"))
    records = source.withColumn("producer_id", F.lit(None).cast("string")).withColumn("sequence", F.lit(None).cast("long"))
    return produce(records, PARTITIONS, ["ts", "event_id"], "event_id").select("event_id", "partition", "offset", "error")
