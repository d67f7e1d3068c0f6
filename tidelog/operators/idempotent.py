"""Idempotent produce: the sequence window of each producer and partition."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..model import MAX_PRODUCERS_PER_KEY, PRODUCER_IDLE_MS, PRODUCER_WINDOW
from .folds import numbered, ordered_fold


class SequenceWindow:
    """State of one (producer, topic, partition): the last sequence and the newest ones with what was stored for each."""

    def __init__(self, last: int | None = None, recent: list[tuple[int, object]] = ()):
        self.last, self.recent = last, OrderedDict(recent)

    def judge(self, seq: int) -> tuple[str, object]:
        if self.last is None or seq == self.last + 1:
            return "accept", None
        if seq > self.last + 1:
            return "gap", None
        if seq in self.recent:
            return "duplicate", self.recent[seq]
        return ("duplicate", None) if seq == self.last else ("too_low", None)

    def accept(self, seq: int, what: object) -> None:
        self.last = seq
        self.recent[seq] = what
        while len(self.recent) > PRODUCER_WINDOW:
            self.recent.popitem(last=False)


def judge_request(windows: dict, rows: list[tuple[tuple, int, object]]) -> list[tuple[str, object]]:
    """Outcomes of one request's rows (place, sequence, mark). Decisions come before all writes: any gap or low sequence rejects the request; behind the first
    accepted row of a place each must follow the one before. Rejected rows keep their own verdict with the prefix rejected."""
    out, ahead, refused = [], {}, False
    for place, seq, _ in rows:
        if place in ahead:
            verdict = ("accept", None) if seq == ahead[place] + 1 else ("gap" if seq > ahead[place] else "too_low", None)
        else:
            verdict = windows.setdefault(place, SequenceWindow()).judge(seq)
        if verdict[0] == "accept":
            ahead[place] = seq
        refused |= verdict[0] in ("gap", "too_low")
        out.append(verdict)
    if refused:
        return [(v if v in ("gap", "too_low") else "rejected", None) for v, _ in out]
    for (place, seq, mark), (verdict, _) in zip(rows, out):
        if verdict == "accept":
            windows[place].accept(seq, mark)
    return out


def _places(columns: list[str]) -> list[str]:
    """What a window belongs to within a producer: the topic, where records have one, and the partition."""
    return [c for c in ("topic", "partition") if c in columns]


#: What a window keeps of a sequence: the mark of a record of this run, or the offset that a former run stored.
_OUTCOME = "outcome string, original bigint, known_offset bigint"


def _found(what: tuple[int | None, int | None] | None) -> tuple[int | None, int | None]:
    return what or (None, None)


def _window(last: int, last_offset: int | None, recent: list[dict] | None) -> SequenceWindow:
    return SequenceWindow(last, [(r["seq"], (None, r["offset"])) for r in recent or []] or [(last, (None, last_offset))])


def _united(rows: DataFrame, stored: DataFrame, content: str) -> DataFrame:
    """rows and the stored ones that they go on from, whose column content differs from row to row. They are hashed by content: Spark takes a union of sides hashed alike by a place for hashed by it and leaves
    out the shuffle, but adaptive execution merges each side's partitions by itself, so what is stored would be in another task than the records of its place."""
    return rows.unionByName(stored.repartition(content), allowMissingColumns=True)


def classify(records: DataFrame, order: list[str], mark: str, state: DataFrame | None = None) -> DataFrame:
    """Adds outcome (accept, duplicate, gap, too_low), original (mark of the accepted record that a duplicate repeats) and known_offset (its offset, where a former run
    stored it) to single-record requests (producer_id, topic if there is one, partition, sequence). mark: a bigint column that names a record. state: the table of
    producer_state(); its windows go on, and a producer that isn't in it starts anew. A window is a row ahead of the records of its place, so it is never joined to each of them."""
    places = _places(records.columns)
    held = "struct<last_seen:bigint,last_offset:bigint,recent:array<struct<seq:bigint,offset:bigint>>>"

    def start() -> list:
        return [SequenceWindow()]

    def step(at: list[SequenceWindow], row: tuple) -> tuple[str | None, int | None, int | None]:
        seq, own, stored = row
        if stored is not None:
            at[0] = _window(stored["last_seen"], stored["last_offset"], stored["recent"])
            return None, None, None
        verdict, what = at[0].judge(seq)
        if verdict == "accept":
            at[0].accept(seq, (own, None))
        return verdict, *_found(what)

    if state is None:
        return ordered_fold(records, ["producer_id", *places], order, ["sequence", mark], start, lambda at, row: step(at, (*row, None)), _OUTCOME)
    windows = state.select("producer_id", *places, F.struct("last_seen", "last_offset", "recent").cast(held).alias("_state"))
    rows = _united(records.withColumn("_state", F.lit(None).cast(held)), windows, "_state")
    # Nulls sort first, so the flag is what puts the window ahead.
    flagged = rows.withColumn("_later", F.col("_state").isNull())
    judged = ordered_fold(flagged, ["producer_id", *places], ["_later", *order], ["sequence", mark, "_state"], start, step, _OUTCOME)
    return judged.where("_later").drop("_state", "_later")


def request_verdicts(records: DataFrame, order: list[str], mark: str, state: DataFrame | None = None) -> DataFrame:
    """Outcome, original and known_offset as in classify(), of requests (request_id) of several records, beside their mark, topic, partition and order columns; a request's
    rows are gathered, so its size bounds the memory. Groups are producers, as a rejected request may span partitions. The windows of a producer's places are one row ahead
    of its requests."""
    places = _places(records.columns)
    where = F.struct(*[F.col(c) for c in places])
    ordered = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(order)], where.alias("place"), "sequence", F.col(mark).alias("mark"))))
    requests = records.groupBy("producer_id", "request_id").agg(ordered.alias("rows")).withColumn("first", F.col("rows")[0]["_by0"])
    kinds = ",".join(f"{c}:{records.schema[c].dataType.simpleString()}" for c in places)
    held = f"array<struct<place:struct<{kinds}>,last_seen:bigint,last_offset:bigint,recent:array<struct<seq:bigint,offset:bigint>>>>"
    rows = requests.withColumn("_state", F.lit(None).cast(held))
    if state is not None:
        windows = state.groupBy("producer_id").agg(F.collect_list(F.struct(where.alias("place"), "last_seen", "last_offset", "recent")).cast(held).alias("_state"))
        rows = _united(rows, windows, "_state")
    verdict = StructType.fromDDL(_OUTCOME)
    listed = pa.list_(pa.struct([pa.field(f.name, to_arrow_type(f.dataType)) for f in verdict.fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, producer = {}, ()
        for batch in batches:
            asked, out, lengths = batch.column("rows"), [], [0]
            # The rows of all requests lie behind one another: their columns are read as wholes, never as a dict for each row.
            flat = asked.flatten()
            place, sequences, marks = flat.field("place"), flat.field("sequence").to_pylist(), [(m, None) for m in flat.field("mark").to_pylist()]
            every = list(zip(list(zip(*(place.field(c).to_pylist() for c in places))), sequences, marks))
            sizes = asked.value_lengths().to_pylist()
            at = 0
            for who, size, stored in zip(batch.column("producer_id").to_pylist(), sizes, batch.column("_state").to_pylist()):
                if (who,) != producer:
                    producer, windows = (who,), {}
                if stored is not None:
                    windows.update({tuple(w["place"].values()): _window(w["last_seen"], w["last_offset"], w["recent"]) for w in stored})
                if size:
                    out.extend((v, *_found(what)) for v, what in judge_request(windows, every[at : at + size]))
                    at += size
                lengths.append(at)
            columns = zip(*out) if out else [()] * len(verdict.fields)
            judged = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, listed.value_type)], fields=list(listed.value_type))
            yield pa.RecordBatch.from_arrays([asked, pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), judged, type=listed)], names=["rows", "judged"])

    ddl = f"rows {rows.schema['rows'].dataType.simpleString()}, judged array<{verdict.simpleString()}>"
    flagged = rows.withColumn("_later", F.col("_state").isNull()).repartition("producer_id").sortWithinPartitions("producer_id", "_later", "first", "request_id")
    judged = flagged.select("producer_id", "rows", "_state").mapInArrow(run, ddl).where("rows is not null").select(F.inline(F.arrays_zip("rows", "judged")))
    # A place or a mark may be among the order columns as well.
    named = {mark: F.col("rows.mark"), **{c: F.col(f"rows.place.{c}") for c in places}, **{c: F.col(f"rows._by{i}") for i, c in enumerate(order)}}
    return judged.select(*[c.alias(n) for n, c in named.items()], "judged.outcome", "judged.original", "judged.known_offset")


def classify_requests(records: DataFrame, order: list[str], mark: str, state: DataFrame | None = None) -> DataFrame:
    """As classify(), for requests (request_id) of several records: see request_verdicts()."""
    return records.join(request_verdicts(records, order, mark, state).select(mark, "outcome", "original", "known_offset"), mark)


#: Rows that get no number are dealt to that many groups, so that none of them is large.
_LANES = 64


def numbers(judged: DataFrame, places: list[str], order: list[str], mark: str, next_offsets: DataFrame | None = None, ranges: int | None = None) -> DataFrame:
    """Adds offset to judged records: accepted ones are numbered within their place, a duplicate has the offset of what it repeats, others have none. Every row goes on by
    itself, so what judged them runs once. ranges: see folds.numbered(); places must not be null with them."""
    new = F.col("outcome") == "accept"
    laned = judged.withColumn("_lane", F.when(new, -1).otherwise(F.pmod(F.hash(mark), F.lit(_LANES))))
    offset = F.col("offset")
    if ranges:
        laned = laned.withColumns({f"_in_{c}": F.when(new, F.col(c)).otherwise(F.lit(0).cast(judged.schema[c].dataType)) for c in places})
    ranked = numbered(laned, [*[f"_in_{c}" if ranges else c for c in places], "_lane"], order, "offset", ranges)
    if next_offsets is not None:
        ranked = ranked.join(next_offsets, places, "left")
        offset = offset + F.coalesce("next_offset", F.lit(0).cast("long"))
    stored = ranked.withColumn("offset", F.when(new, offset))
    again = F.when(F.col("outcome") == "duplicate", F.col("original"))
    same = Window.partitionBy("_named")
    found = stored.withColumn("_named", F.coalesce(again, F.col(mark))).withColumn("_first", F.max("offset").over(same))
    repeated = F.coalesce("known_offset", F.when(again.isNotNull(), F.col("_first")))
    return found.withColumn("offset", F.when(new, F.col("offset")).when(F.col("outcome") == "duplicate", repeated)).select(*judged.columns, "offset")


def with_offsets(classified: DataFrame, order: list[str], mark: str, next_offsets: DataFrame | None = None) -> DataFrame:
    """Adds offset and duplicate to accepted records and their duplicates; others are left out. next_offsets: (topic if there is one, partition, next_offset)."""
    placed = numbers(classified.where("outcome in ('accept', 'duplicate')"), _places(classified.columns), order, mark, next_offsets)
    return placed.where("offset is not null").withColumn("duplicate", F.col("outcome") == "duplicate")


def producer_state(with_offset: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """The newest state of each (producer, topic if there is one, partition) from records with offset, sequence and timestamp_ms, and from the state before them; the window
    is bounded, so it is gathered from the newest rows only. Duplicates count as use."""
    places = ["producer_id", *_places(with_offset.columns)]
    new = with_offset.select(*places, F.col("sequence").alias("seq"), "offset", F.col("timestamp_ms").alias("used"), F.col("duplicate").alias("_again"))
    if previous is not None:
        stored = F.when(F.size("recent") > 0, F.col("recent")).otherwise(F.array(F.struct(F.col("last_seen").alias("seq"), F.col("last_offset").alias("offset"))))
        old = previous.select(*places, F.col("last_used_ms").alias("used"), F.explode(stored).alias("r"))
        new = _united(new, old.select(*places, "r.seq", "r.offset", "used", F.lit(False).alias("_again")), "seq")
    # All of it in one pass, so what gave the rows runs once: duplicates rank behind all others and count for the use only.
    rank = F.row_number().over(Window.partitionBy(*places).orderBy("_again", F.desc("offset")))
    held = ~F.col("_again") & (rank <= PRODUCER_WINDOW)
    marked = new.withColumn("_held", held).withColumn("seq", F.when(F.col("_held"), F.col("seq")))
    newest = F.collect_list(F.when(F.col("_held"), F.struct("seq", "offset")))
    windows = marked.groupBy(*places).agg(F.max("seq").alias("last_seen"), F.max_by("offset", "seq").alias("last_offset"), F.array_sort(newest).alias("recent"), F.max("used").alias("last_used_ms"))
    return windows.where(F.size("recent") > 0)


def expire(state: DataFrame, now_ms: int, idle_ms: int = PRODUCER_IDLE_MS) -> DataFrame:
    """Forgets producers that used none of their places for longer than idle_ms."""
    return state.withColumn("_used", F.max("last_used_ms").over(Window.partitionBy("producer_id"))).where(F.col("_used") >= now_ms - idle_ms).drop("_used")


def revoke(state: DataFrame, producer_id: str) -> DataFrame:
    """Forgets a producer: classify() with what is left accepts any sequence of it next."""
    return state.where(F.col("producer_id") != producer_id)


def purge_topic(state: DataFrame, topic: str) -> DataFrame:
    """Forgets the windows of a removed topic, so one created anew under its name starts without them."""
    return state.where(F.col("topic") != topic)


def per_owner(owners: DataFrame) -> DataFrame:
    """Producers of each owner, from (producer_id, owner)."""
    return owners.groupBy("owner").agg(F.count_distinct("producer_id").alias("producers"))


def admit(requests: DataFrame, owners: DataFrame, order: list[str], most: int = MAX_PRODUCERS_PER_KEY) -> DataFrame:
    """Adds error to requests (producer_id, key_id, may_claim): a producer belongs to the first key that may claim it, and is unavailable to others, as is an unclaimed one
    to a key that may not; a key that owns most producers gets no further one (producer_limit). owners: (producer_id, owner) before the requests."""
    fresh = requests.where("may_claim").join(owners, "producer_id", "left_anti")
    first = fresh.groupBy("producer_id").agg(F.min(F.struct(*order, "key_id")).alias("f"))
    rank = F.row_number().over(Window.partitionBy("f.key_id").orderBy("f"))
    held = per_owner(owners).select(F.col("owner").alias("key_id"), F.col("producers"))
    claims = first.select("producer_id", F.col("f.key_id").alias("key_id"), rank.alias("_rank")).join(held, "key_id", "left")
    claims = claims.select("producer_id", F.col("key_id").alias("owner"), (F.col("_rank") + F.coalesce("producers", F.lit(0)) > most).alias("_over"))
    known = owners.select("producer_id", "owner", F.lit(False).alias("_over")).unionByName(claims)
    mine = F.col("owner") == F.col("key_id")
    error = F.when(F.col("owner").isNull() | ~mine, "unavailable").when(F.col("_over"), "producer_limit")
    return requests.join(known, "producer_id", "left").withColumn("error", error).drop("owner", "_over")


def listing(state: DataFrame) -> DataFrame:
    places = ["producer_id", *_places(state.columns)]
    return state.select(*places, "last_seen", "last_offset").orderBy(*places)
