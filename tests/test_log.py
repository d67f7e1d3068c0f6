"""Rules of the log, by small cases."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog import model
from tidelog.functions import core
from tidelog.model import LogError
from tidelog.operators import auth, catalog, consume, coord, groups, idempotent, log, maintain, produce, registry, segments
from tidelog.operators import keys as keys_
from tidelog.sources import backup, bytelog, codec

RECORDS = "topic string, partition int, offset bigint, timestamp_ms bigint, key binary, value binary"


def make(spark, rows, partition=0, ts=lambda i: i):
    return spark.createDataFrame([("t", partition, i, ts(i), None if k is None else k.encode(), v.encode()) for i, (k, v) in enumerate(rows)], RECORDS)


def fnv(data: bytes) -> int:
    h = 14695981039346656037
    for b in data:
        h = (h ^ b) * 1099511628211 % 2**64
    return h


def test_hash(spark):
    keys = ["", "a", "alpha", "é的", "x" * 100, None]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select(core.fnv1a64(F.col("k")).alias("h"), core.key_partition(F.col("k"), F.lit(7)).alias("p")).collect()
    for k, r in zip(keys, got):
        assert (r["h"] is None) == (k is None)
        if k is not None:
            assert (r["h"]["hi"] << 32) + r["h"]["lo"] == fnv(k.encode()) and r["p"] == fnv(k.encode()) % 7


def test_routing_and_hint_out_of_range(spark):
    rows = spark.createDataFrame([(i, k, h) for i, (k, h) in enumerate([("alpha", None)] * 10 + [(None, None)] * 5 + [("alpha", 3), (None, 2), ("", None)])], "i int, key string, hint int")
    got = {r["i"]: r["partition"] for r in log.route(rows, 4, ["i"], start=2).collect()}
    assert len({got[i] for i in range(10)}) == 1 and [got[i] for i in range(10, 15)] == [2, 3, 0, 1, 2] and (got[15], got[16], got[17]) == (3, 2, fnv(b"") % 4)
    with pytest.raises(Exception, match="out of range"):
        log.route(rows.withColumn("hint", F.lit(4)), 4, ["i"]).collect()


def test_roll_and_fetch(spark):
    rolled = segments.roll(make(spark, [(f"k{i}", f"v{i}") for i in range(100)]), 512, ("topic", "partition"))
    stats = segments.stats(rolled, ("topic", "partition")).collect()
    assert len(stats) >= 2 and all(s["size_bytes"] <= 512 for s in stats) and max(s["end_offset"] for s in stats) == 100
    seen, at = [], 0
    while at < 100:
        page = consume.fetch(rolled, 0, at, max_records=7)
        rows = [r["offset"] for r in page.orderBy("offset").collect()]
        seen += rows
        at = consume.next_offset(page, at, 100)
    assert seen == list(range(100))
    assert consume.fetch(rolled, 0, 100, high_watermark=100).count() == 0 and consume.next_offset(rolled.where("false"), 150, 100) == 150
    assert [r["offset"] for r in consume.fetch(rolled, 0, 3, start_offset=5, max_records=1).collect()] == [5]
    big = segments.roll(make(spark, [("a", "x" * 50), ("b", "x" * 900), ("c", "x")]), 128, ("partition",))
    assert [r["segment_base"] for r in big.orderBy("offset").collect()] == [0, 1, 2]
    assert consume.fetch(big, 0, 1, max_bytes=1).count() == 1


def sequential_retention(segs, over, cutoff):
    out = set()
    for i, (size, ts) in enumerate(segs):
        if cutoff is not None and ts < cutoff:
            out.add(i)
    for i, (size, _) in enumerate(segs):
        if over <= 0:
            break
        out.add(i)
        over -= size
    return out


def test_retention(spark):
    import random

    rng = random.Random(1)
    for _ in range(5):
        sizes = [(rng.randint(1, 50), rng.randint(0, 100)) for _ in range(rng.randint(1, 9))]
        rows = [(0, i, s, t, i == len(sizes) - 1) for i, (s, t) in enumerate(sizes)]
        frame = spark.createDataFrame(rows, "partition int, segment_base long, size_bytes long, max_ts long, is_active boolean")
        budget, total = rng.randint(0, 200), sum(s for s, _ in sizes)
        got = {r["segment_base"] for r in maintain.retention_plan(frame, 100, 60, budget).where("victim").collect()}
        assert got == (sequential_retention(sizes[:-1], total - budget, 40) if len(sizes) > 1 else set())


def test_compaction(spark):
    rows = [(f"k{k}", f"k{k}-v{v}") for v in range(6) for k in range(5)]
    rolled = segments.roll(make(spark, rows), 256, ("partition",))
    out = maintain.compact(rolled, 0, 0, ("partition",))
    latest = {}
    for r in out.orderBy("offset").collect():
        latest[bytes(r["key"])] = r["value"].decode()
    assert latest == {f"k{k}".encode(): f"k{k}-v5" for k in range(5)} and out.select("segment_base").distinct().count() <= 2
    # A null key isn't a key, an empty one is; an old tombstone takes its key along, one at the edge stays; the active segment shadows nothing.
    rows = [(None, "a"), ("", "b"), ("", "c"), ("x", "1"), ("x", ""), ("y", "1"), ("y", ""), (None, "d"), ("z", "old"), ("z", "p" * 300)]
    rolled = segments.roll(make(spark, rows, ts=lambda i: 10 * i), 350, ("partition",))
    kept = {r["offset"] for r in maintain.compaction_marks(rolled, 1060, 1000, ("partition",)).where("keep").collect()}
    assert kept == {0, 2, 6, 7, 8, 9}
    same = segments.roll(make(spark, [("a", "1"), ("b", "2"), ("c", "3")]), 128, ("partition",))
    assert maintain.compact(same, 0, 0, ("partition",)).select("segment_base").distinct().count() == same.select("segment_base").distinct().count()


def test_sequences(spark):
    w = idempotent.SequenceWindow()
    assert w.judge(42)[0] == "accept"
    for s in range(42, 301):
        assert w.judge(s)[0] == "accept"
        w.accept(s, s * 10)
    assert [w.judge(s) for s in (300, 200, 172, 303, 301)] == [("duplicate", 3000), ("duplicate", 2000), ("too_low", None), ("gap", None), ("accept", None)]
    assert idempotent.SequenceWindow(7).judge(7) == ("duplicate", None)


def test_requests_are_all_or_nothing(spark):
    rows = [("p", "r1", 0, s, i) for i, s in enumerate((5, 6, 7))] + [("p", "r2", 0, 8, 3), ("p", "r2", 0, 6, 4)] + [("p", "r3", 0, s, 5 + i) for i, s in enumerate((5, 6, 7))] + [("p", "r4", 0, 8, 8), ("p", "r4", 1, 0, 9), ("p", "r4", 1, 2, 10)] + [("p", "r5", 0, 8, 11)]
    frame = spark.createDataFrame(rows, "producer_id string, request_id string, partition int, sequence long, arrival long")
    got = {r["arrival"]: (r["outcome"], r["original"]) for r in idempotent.classify_requests(frame, ["arrival"], "arrival").collect()}
    assert [got[i][0] for i in range(12)] == ["accept"] * 3 + ["rejected", "too_low"] + ["duplicate"] * 3 + ["rejected", "rejected", "gap", "accept"]
    assert [got[i][1] for i in (5, 6, 7)] == [0, 1, 2]


def test_sequences_go_on_from_stored_state(spark):
    window = [(s, 10 * s) for s in (4, 5)]
    state = spark.createDataFrame([("p", "t", 0, 5, 50, window, 1000), ("q", "t", 0, 9, 90, [], 10)], model.PRODUCER_STATE)
    rows = [("p", "t", 0, 5, 1), ("p", "t", 0, 3, 2), ("p", "t", 0, 6, 3), ("p", "t", 0, 6, 4), ("p", "u", 0, 40, 5), ("q", "t", 0, 9, 6), ("q", "t", 0, 3, 7)]
    frame = spark.createDataFrame(rows, "producer_id string, topic string, partition int, sequence long, arrival long")

    def judged(held):
        single = idempotent.classify(frame, ["arrival"], "arrival", held)
        whole = idempotent.classify_requests(frame.withColumn("request_id", F.col("arrival")), ["arrival"], "arrival", held)
        out = [{r["arrival"]: (r["outcome"], r["original"], r["known_offset"]) for r in d.collect()} for d in (single, whole)]
        assert out[0] == out[1]
        return [out[0][i] for i in range(1, 8)]

    none = (None, None)
    assert judged(state) == [("duplicate", None, 50), ("too_low", *none), ("accept", *none), ("duplicate", 3, None), ("accept", *none), ("duplicate", None, 90), ("too_low", *none)]
    # Idle since 10: q is forgotten, p isn't.
    assert judged(idempotent.expire(state, 1000, 500))[5:] == [("accept", *none), ("too_low", *none)]
    assert judged(idempotent.revoke(state, "p"))[:2] == [("accept", *none), ("too_low", *none)]
    assert idempotent.purge_topic(state, "t").isEmpty()


def test_state_meets_its_records_where_sides_are_hashed_alike(spark):
    """Each side's shuffle merges its partitions by itself, the larger one's into more tasks."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4kb", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1kb"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        place, kinds = ["producer_id", "topic", "partition"], "producer_id string, topic string, partition int, sequence long, arrival long"
        frame = spark.createDataFrame([("p", "t", p, 6 + i, 1000 * p + i) for p in range(8) for i in range(300)], kinds).repartition(*place)
        state = spark.createDataFrame([("p", "t", p, 5 + p % 2 * 10_000, 50, [], 0) for p in range(8)], model.PRODUCER_STATE).repartition(*place)
        single = idempotent.classify(frame, ["arrival"], "arrival", state)
        whole = idempotent.classify_requests(frame.withColumn("request_id", F.col("arrival")), ["arrival"], "arrival", state)
        for judged in (single, whole):
            assert {tuple(r) for r in judged.groupBy("partition", "outcome").count().collect()} == {(p, "too_low" if p % 2 else "accept", 300) for p in range(8)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def folds_in(df):
    """How often a plan runs a fold, shared exchanges left aside."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_whole_requests_are_judged_once(spark):
    rows = [("r1", "p", 0, b"k", 1), ("r1", "p", 1, b"k", 2), ("r2", "p", 0, b"k", 3), ("r2", "p", 1, b"k", 4), ("r3", "p", 9, b"k", 5), ("r4", None, None, b"k", 6), ("r5", "bad id", 1, b"k", 7), ("r6", "q", -1, b"k", 8), ("r6", "q", 0, b"k", 9)]
    kinds = "request_id string, producer_id string, sequence long, key binary, n long"
    frame = spark.createDataFrame(rows, kinds).withColumn("value", F.lit(b"v")).withColumn("hint", F.lit(0))
    for ranges in (None, 2):
        done = produce.produce(frame, 1, ["n"], "n", ranges=ranges)
        assert ranges or folds_in(done) == 1
        got = {r["n"]: (r["partition"], r["offset"], r["duplicate"], r["error"]) for r in done.collect()}
        none = (None, None, None)
        want = {1: (0, 0, False, None), 2: (0, 1, False, None), 3: (0, 0, True, None), 4: (0, 1, True, None), 5: (*none, "gap"), 6: (0, 2, False, None)}
        assert got == {**want, 7: (*none, "bad_producer_id"), 8: (*none, "negative_sequence"), 9: (*none, "negative_sequence")}


def test_offsets_of_retries_come_from_one_fold(spark):
    kinds = "producer_id string, topic string, partition int, sequence long, n long, timestamp_ms long"
    rows = [("p", "t", 0, 6, 1, 10), ("q", "t", 0, 3, 2, 20), ("p", "t", 0, 6, 3, 30), ("p", "t", 0, 5, 4, 40), ("p", "t", 0, 8, 5, 50), ("p", "t", 0, 1, 6, 60), ("p", "u", 0, 9, 7, 70), ("p", "t", 0, 7, 8, 80), ("q", "t", 0, 3, 9, 90)]
    state = spark.createDataFrame([("p", "t", 0, 5, 50, [(5, 50)], 0)], model.PRODUCER_STATE)
    ends = spark.createDataFrame([("t", 0, 100)], "topic string, partition int, next_offset long")
    done = idempotent.with_offsets(idempotent.classify(spark.createDataFrame(rows, kinds), ["n"], "n", state), ["n"], "n", ends)
    assert folds_in(done) == 1
    want = {1: (100, False), 2: (101, False), 3: (100, True), 4: (50, True), 7: (0, False), 8: (102, False), 9: (101, True)}
    assert {r["n"]: (r["offset"], r["duplicate"]) for r in done.collect()} == want


def test_state_comes_from_one_fold(spark):
    kinds = "producer_id string, topic string, partition int, sequence long, n long, timestamp_ms long"
    rows = [("p", "t", 0, i, 2 * i, i) for i in range(200)] + [("p", "t", 0, 150, 301, 9_000), ("q", "t", 0, 7, 1, 5)]
    done = idempotent.with_offsets(idempotent.classify(spark.createDataFrame(rows, kinds), ["n"], "n"), ["n"], "n")
    state = idempotent.producer_state(done)
    assert folds_in(state) == 1
    got = {r["producer_id"]: (r["last_seen"], r["last_offset"], r["last_used_ms"], [tuple(w) for w in r["recent"]]) for r in state.collect()}
    assert got == {"p": (199, 200, 9_000, [(s, s + 1) for s in range(72, 200)]), "q": (7, 1, 5, [(7, 1)])}


def test_lag_and_reset(spark):
    ends = spark.createDataFrame([("t", 0, 0, 10)], "topic string, partition int, start_offset long, end_offset long")
    commits = spark.createDataFrame([("g1", "t", 0, 4, 1), ("g2", "t", 0, 7, 2), ("g1", "t", 0, 3, 3), ("g3", "t", 0, 99, 4)], model.COMMIT_SCHEMA)
    assert {r["group"]: r["lag"] for r in groups.lag(commits, ends).collect()} == {"g1": 7, "g2": 3, "g3": 0}
    fresh, report = groups.reset(commits.where("`group` <> 'g3'"), ends, "t")
    assert tuple(report.first()) == (2, 2) and {r["offset"] for r in groups.latest_commits(fresh).collect()} == {0}


def test_assignment():
    assert coord.assign({"a": ["t"], "b": ["t"]}, {"t": 2}) == {"a": [("t", 0)], "b": [("t", 1)]}
    three = coord.assign({m: ["t"] for m in "abc"}, {"t": 4})
    left = coord.assign({m: ["t"] for m in "ac"}, {"t": 4}, three)
    assert set(three["a"]) <= set(left["a"]) and sum(map(len, left.values())) == 4
    two = coord.assign({m: ["t"] for m in "ab"}, {"t": 6})
    grown = coord.assign({m: ["t"] for m in "abc"}, {"t": 6}, two)
    assert sorted(map(len, grown.values())) == [2, 2, 2] and set(grown["a"]) <= set(two["a"])
    assert coord.assign({"a": ["x"], "b": ["y"]}, {"x": 5, "y": 1}) == {"a": [("x", 0), ("x", 1), ("x", 2)], "b": [("y", 0)]}


def test_membership():
    g, parts = coord.Group(), {"t": 4}
    a, generation, got = g.join(["t", "t"], parts, 0)
    assert a.startswith("m_") and len(a) == 26 and generation == 1 and len(got) == 4
    g.join(["t"], parts, 0, "b")
    assert g.heartbeat("b", 1, 5) == "rebalance_required" and g.heartbeat("b", 2, 5) == "ok" and g.heartbeat("zz", 2, 5) == "unknown_member"
    assert g.join(["t"], parts, 9, "b")[1] == 2
    assert g.expire(15_009, parts) == [a] and g.generation == 3 and g.expire(15_009, parts) == []
    g.leave("nobody", parts)
    assert g.generation == 3
    with pytest.raises(LogError):
        g.join(["gone"], parts, 0)


def test_prefixes(spark):
    cases = [("orders", "orders", True), ("orders", "orders.eu", True), ("orders", "ordersecret", False), ("orders", "orders-archive", False), ("acme-", "acme-corp", True), ("*", "x", True), ("", "x", False), ("orders.eu", "orders", False)]
    got = spark.createDataFrame(cases, "p string, n string, want boolean").select(core.prefix_match(F.col("p"), F.col("n")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
    subjects = spark.createDataFrame([("user-value",), ("user-key",), ("-value",), ("user",)], "s string").select(core.subject_topic(F.col("s"))).collect()
    assert [r[0] for r in subjects] == ["user", "user", "-value", "user"]


def test_consume_quota():
    b = auth.ConsumeBucket(100)
    got = b.reserve(60, 0)
    b.settle(got, 250)
    assert got == 60 and b.reserve(10, 1.0) is None and b.reserve(10, 2.6) == 10 and auth.ConsumeBucket(0).reserve(7, 0) == 7


def test_registry(spark):
    r = spark.createDataFrame([], model.SCHEMA_REGISTRY)
    full = '{"properties":{"name":{},"age":{}},"required":["name"]}'
    r, one = registry.register(r, "user-value", "json_schema", full, 1)
    assert one == 1
    with pytest.raises(LogError, match="incompatible"):
        registry.register(r, "user-value", "json_schema", '{"properties":{"name":{}},"required":["name"]}', 2)
    for bad in ("no json", ""):
        with pytest.raises(LogError):
            registry.register(r, "user-value", "avro", bad, 2)
    r, two = registry.register(r, "user-value", "json_schema", full, 2)
    assert two == 2 and registry.latest(r).first()["id"] == 2
    acls = spark.createDataFrame([("k", "read", "user", False)], "key_id string, action string, topic_prefix string, disabled boolean")
    assert registry.readable(r, acls, "k").count() == 2 and registry.readable(r, acls, "other").count() == 0


def test_catalog(spark):
    topics = catalog.create(spark.createDataFrame([], model.TOPIC_CATALOG), "a", 4, retention_ms=5)
    topics = catalog.patch(topics, "a", segment_bytes=4096)
    assert catalog.resolved(topics).first().asDict() == {"name": "a", "partitions": 4, "retention_ms": 5, "retention_bytes": None, "cleanup_policy": "delete", "segment_bytes": 4096, "tombstone_retention_ms": 86_400_000}
    for call, status in ((lambda: catalog.create(topics, "a"), 409), (lambda: catalog.create(topics, ".."), 400), (lambda: catalog.create(topics, "b", 0), 400), (lambda: catalog.patch(topics, "a", segment_bytes=1), 400), (lambda: catalog.patch(topics, "zz"), 404)):
        with pytest.raises(LogError) as e:
            call()
        assert e.value.status == status
    assert catalog.purge("a", topics)[0].count() == 0


def test_codec(spark):
    frame = make(spark, [("k", "v"), (None, ""), ("", "é" * 100)])
    got = codec.with_record(frame).orderBy("offset").collect()
    plain = [codec.encode(r["offset"], r["timestamp_ms"], None if r["key"] is None else bytes(r["key"]), bytes(r["value"])) for r in got]
    assert [bytes(r["record"]) for r in got] == plain and all(len(p) == 32 + len(r["key"] or b"") + len(r["value"]) for p, r in zip(plain, got))
    data = b"".join(plain)
    assert [r[0] for r in codec.scan(data)] == [0, 1, 2] and [r[0] for r in codec.scan(data[:-1])] == [0, 1]
    hurt = bytearray(data)
    hurt[len(plain[0]) + 10] ^= 1
    assert [r[0] for r in codec.scan(bytes(hurt))] == [0]
    with pytest.raises(ValueError):
        list(codec.scan(bytes(hurt), failfast=True))


def test_byte_log(spark, tmp_path):
    rows = make(spark, [(f"k{i % 5}", f"v{i}") for i in range(60)]).unionByName(make(spark, [(None, "x")] * 7, partition=1))
    rolled = segments.roll(rows, 256, ("topic", "partition"))
    root = f"{tmp_path}/log"
    bytelog.write(rolled, root)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(bytelog.ByteLogSource)
    back = spark.read.format("tidelog").option("path", root).load()
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert back.where("topic = 't' and partition = 0 and offset >= 57").count() == 3
    q = spark.readStream.format("tidelog").option("path", root).load().writeStream.format("memory").queryName("bytes").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("bytes").count() == 67


def test_backup(spark, tmp_path):
    rolled = segments.roll(make(spark, [(f"k{i}", f"v{i}") for i in range(30)]), 256, ("topic", "partition"))
    path, target = f"file://{tmp_path}/dump", f"file://{tmp_path}/data"
    backup.dump(rolled, path, 5)
    m = backup.verify(spark, path).first()
    assert (m["version"], m["topics"], m["records"], m["includes_keys"]) == (1, ["t"], 30, False)
    assert backup.restore(spark, path, target) is None and backup.restore(spark, path, target) is not None
    assert spark.read.parquet(f"{target}/log").count() == 30
    with pytest.raises(LogError):
        backup.restore(spark, path, target, with_keys=True)
    with pytest.raises(LogError):
        backup.restore(spark, path, target, most_bytes=1)


def test_cold_tier_and_lines(spark, tmp_path):
    rolled = segments.roll(make(spark, [(f"k{i}", f"v{i}") for i in range(50)]), 256, ("topic", "partition"))
    planned = maintain.retention_plan(segments.stats(rolled, ("topic", "partition")), 10_000, 1, None, ("topic", "partition"))
    n = maintain.offload(rolled, planned, f"{tmp_path}/cold", ("topic", "partition"))
    assert n > 0 and maintain.cold_bases(spark, f"{tmp_path}/cold", ("topic", "partition")).count() == planned.where("victim").count()
    assert maintain.retrieve(spark, f"{tmp_path}/cold").count() == n and maintain.apply_retention(rolled, planned, ("topic", "partition")).count() == 50 - n
    (tmp_path / "in.txt").write_text("a\n\nb\nc\n")
    assert [(r["value"], r["sequence"]) for r in log.from_lines(spark, f"{tmp_path}/in.txt", first_sequence=4).orderBy("sequence").collect()] == [("a", 4), ("b", 5), ("c", 6)]


def test_cold_segments_are_replaced_and_removed(spark, tmp_path):
    keys, cold = ("topic", "partition"), f"{tmp_path}/cold"
    rolled = segments.roll(make(spark, [(f"k{i}", f"v{i}") for i in range(50)]), 256, keys)
    planned = maintain.retention_plan(segments.stats(rolled, keys), 10_000, 1, None, keys)
    n = maintain.offload(rolled, planned, cold, keys)
    assert maintain.offload(rolled, planned, cold, keys) == n and maintain.retrieve(spark, cold, "t").count() == n
    bases = [r["segment_base"] for r in maintain.cold_bases(spark, cold, keys).collect()]
    assert [r["offset"] for r in maintain.retrieve(spark, cold, "t", 0, bases[1]).orderBy("offset").collect()] == list(range(bases[1], bases[2]))
    maintain.delete_cold(spark, cold, "t", 0, bases[1])
    maintain.delete_cold(spark, cold, "t", 0, bases[1])
    assert [r["segment_base"] for r in maintain.cold_bases(spark, cold, keys).collect()] == [b for b in bases if b != bases[1]]
    with pytest.raises(LogError):
        maintain.retrieve(spark, cold, "t", 0, bases[1])
    for bad in ("..", "a/b", "", "t\n"):
        with pytest.raises(LogError):
            maintain.purge_cold(spark, cold, bad)
    maintain.purge_cold(spark, cold, "t")
    assert not (tmp_path / "cold" / "topic=t").exists()


def test_produce_requests(spark):
    requests = [
        [("p", 0, "a", "v", None), ("p", 1, "a", "v", None)],
        [("p", 0, "a", "other", None), ("p", 1, "a", "v", None)],  # a retry
        [("p", 3, "a", "v", None)],  # a gap
        [("p", 2, "a", "v", None), ("p", 1, "a", "v", None)],  # low behind an accepted one: refused whole
        [(None, None, "a", "v", None), (None, None, None, "v", None), (None, None, None, "v", None)],
        [(None, None, None, "v", None), (None, None, "a", "v", 9)],  # one bad hint refuses both and takes no turn of the counter
        [("p", None, "a", "v", None), ("q", -1, "a", "v", None)],  # the earlier check of the two answers
        [("p", 2, "a", "v", None)],
        [(None, None, None, "v", 3)],
    ]
    rows = [(n, n * 10 + i, *r) for n, request in enumerate(requests) for i, r in enumerate(request)]
    frame = spark.createDataFrame(rows, "request_id int, mark long, producer_id string, sequence long, key string, value string, hint int")
    ends = spark.createDataFrame([(fnv(b"a") % 4, 100)], "partition int, next_offset long")
    got = {r["mark"]: (r["partition"], r["offset"], r["duplicate"], r["error"]) for r in produce.produce(frame, 4, ["mark"], "mark", ends).collect()}
    home, log_ = fnv(b"a") % 4, {}
    for mark, at, duplicate in [(0, home, False), (1, home, False), (40, home, False), (41, 0, False), (42, 1, False), (70, home, False), (80, 3, False)]:
        log_.setdefault(at, 100 if at == home else 0)
        assert got[mark] == (at, log_[at], duplicate, None)
        log_[at] += 1
    assert got[10] == (home, 100, True, None) and got[11] == (home, 101, True, None)
    assert {m: got[m][3] for m in (20, 30, 31, 50, 51, 60, 61)} == {20: "gap", 30: "rejected", 31: "too_low", 50: "partition_out_of_range", 51: "partition_out_of_range", 60: "sequence_required", 61: "sequence_required"}
    assert len(got) == len(rows) and all(got[m][:3] == (None, None, None) for m in (20, 30, 31, 50, 51, 60, 61))
    refused = produce.produce(frame, 4, ["mark"], "mark", can_write=F.col("request_id") != 4).where("error = 'forbidden'")
    assert {r["mark"] for r in refused.collect()} == {40, 41, 42}


def test_keys(spark):
    table = spark.createDataFrame([], model.API_KEYS)
    table, first, secret = keys_.create(table, "one", [("write", "orders"), ("admin", "*")], 20, 100, 0)
    table, second, other = keys_.create(table, "two", [], 10, secret="s")
    assert secret != other == "s" and first.startswith("key_") and [r["name"] for r in keys_.listing(table).collect()] == ["two", "one"]
    attempts = spark.createDataFrame([(secret,), ("s",), ("x",)], "secret string")
    assert {r["key_id"] for r in auth.authenticate(attempts, table).collect()} == {first, second}
    table = keys_.revoke(table, first)
    assert {r["key_id"] for r in auth.authenticate(attempts, table).collect()} == {second} and table.count() == 2
    assert {(r["key_id"], r["rate"]) for r in keys_.rates(table, "produce_bps").collect()} == {(first, 100), (second, None)} and keys_.rates(table, "consume_bps").where("rate is not null").isEmpty()
    assert auth.grants(table).where("disabled").count() == 2
    with pytest.raises(LogError):
        keys_.revoke(table, "key_absent")
    for name, acls in (("", []), ("n", [("read", "")]), ("n", [("read", "a b")]), ("n", [("drop", "a")]), ("n", [("read", "a")] * 101)):
        with pytest.raises(LogError):
            keys_.create(table, name, acls, 0)


def test_explicit_offsets(spark):
    rows = make(spark, [("a", "1"), ("b", "2"), ("c", "3")])
    ends = spark.createDataFrame([("t", 0, 2)], "topic string, partition int, next_offset long")
    assert [r["offset"] for r in log.apply_explicit(ends, rows).collect()] == [2]


def test_numbers_by_ranges_equal_those_of_a_window(spark):
    from tidelog.operators.folds import numbered

    rows = spark.createDataFrame([(i % 3 if i % 5 else 0, (i * 37) % 50, i) for i in range(400)], "g int, t long, i long")
    plain = {r["i"]: r["n"] for r in numbered(rows, ["g"], ["t", "i"], "n").collect()}
    assert {r["i"]: r["n"] for r in numbered(rows, ["g"], ["t", "i"], "n", 7).collect()} == plain
    source = rows.select(F.timestamp_seconds("t").alias("ts"), "i", F.when(F.col("i") % 2 == 0, F.col("g").cast("string")).alias("key"))
    one = log.assign_offsets(log.route(source, 4, ["ts", "i"]), ["ts", "i"])
    many = log.assign_offsets(log.route(source, 4, ["ts", "i"], ranges=5), ["ts", "i"], ranges=5)
    assert one.select("i", "partition", "offset").exceptAll(many.select("i", "partition", "offset")).isEmpty() and many.count() == 400
    assert numbered(rows.where("false"), ["g"], ["t", "i"], "n", 7).count() == 0


def test_fnv_of_any_bytes(spark):
    from tidelog.functions import core

    rng = random.Random(6)
    keys = [b"", b"\x00", bytes(range(256)), "é的😀".encode(), *[rng.randbytes(rng.randint(1, 40)) for _ in range(200)]]

    def plain(data):
        h = 14695981039346656037
        for x in data:
            h = (h ^ x) * 1099511628211 % 2**64
        return h

    rows = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary").select(core.fnv1a64(F.col("k")).alias("h")).collect()
    assert [(r["h"]["hi"] << 32) | r["h"]["lo"] for r in rows] == [plain(k) for k in keys]


def test_round_robin_counts_by_topic(spark):
    from tidelog.operators import log

    rows = [("a" if i % 3 else "b", None, b"v", i) for i in range(30)]
    got = log.route(spark.createDataFrame(rows, "topic string, key binary, value binary, at int"), 4, ["at"]).orderBy("at").collect()
    for topic in "ab":
        assert [r["partition"] for r in got if r["topic"] == topic] == [i % 4 for i in range(sum(x[0] == topic for x in rows))]


def test_upkeep_counters(spark):
    from tidelog.operators import metrics

    report = spark.createDataFrame([("t", 0, 5, 3, 2), ("t", 1, 9, 0, 0)], "topic string, partition int, kept long, dropped long, sealed_merged long")
    got = {(r["metric"], r["labels"]["partition"]): r["value"] for r in metrics.upkeep(metrics.compaction(report)).collect()}
    assert got == {("es_compaction_runs_total", "0"): 1, ("es_compaction_records_dropped_total", "0"): 3, ("es_compaction_runs_total", "1"): 0, ("es_compaction_records_dropped_total", "1"): 0}
    gone = spark.createDataFrame([("t", 0, 4, 2, 99)], "topic string, partition int, start_offset long, segments_deleted long, bytes_reclaimed long")
    assert {r["metric"]: r["value"] for r in metrics.upkeep(metrics.retention(gone)).collect()} == {"es_retention_segments_deleted_total": 2, "es_retention_bytes_reclaimed_total": 99}
    read = spark.createDataFrame([("t", b"k", b"vv"), ("t", None, b"v")], "topic string, key binary, value binary")
    assert {r["metric"]: r["value"] for r in metrics.topics(metrics.consumed(read)).collect()} == {"es_topic_records_consumed_total": 2, "es_topic_bytes_consumed_total": 4}


def test_durations():
    given = {"0": 0, "7d": 7 * 86_400_000, "1h 30m": 5_400_000, "1h30m": 5_400_000, "500ms": 500, "2 weeks": 1_209_600_000, "1M": 2_630_016_000, "1m": 60_000, "1y": 31_557_600_000, "1500us 600us": 2}
    assert {text: model.duration_ms(text) for text in given} == given
    for bad in ("", "  ", "5", "d", "1x", "-1s", "1.5h", "1h,30m", "10 s 5"):
        with pytest.raises(LogError):
            model.duration_ms(bad)


def test_health(spark):
    topics = spark.createDataFrame([], model.TOPIC_CATALOG)
    assert catalog.health(topics).first().asDict() == {"status": "ok", "topics_count": 0}
    assert catalog.health(catalog.create(topics, "a", 2)).first()["topics_count"] == 1
