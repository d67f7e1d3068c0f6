"""Near duplicates by SuperMinHash.

Each element of a set draws a random permutation of the slots; its value at the j-th slot of that permutation is j plus a uniform fraction, and a
slot of the signature keeps the least value of all elements. Slots of an element are thus correlated, which lowers the variance of the estimate.
Elements of a set advance through j together and stop once every slot holds a value below the next j: no later value can
win. Bands of the signature make buckets; every candidate pair is verified on the full sets of shingles.

Documents of one word sequence are one node, named by a 128-bit digest of the words; all further steps go by nodes, not by doc_id. In each bucket all members are compared with its smallest node.
Buckets that this leaves in several components are cut into chunks, and tasks compare two chunks at a time: the sets' elements make
an inverted index that counts all intersections at once, and a task returns a link for each two components that it joins, never its pairs.
Those links are verified like the others. Links make components by contraction.

Defined results: words are runs of bytes other than ASCII white space, A-Z lower-cased. A text without words has no shingles and links with nothing.
Rows of one doc_id are one document, linked by every one of its texts, in whatever order they come. Rows without doc_id link with nothing, have no component and are kept.
Other columns, of whatever name, have no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, runs, slices, stored

BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
#: So many candidate documents' ids (8 bytes each) are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000
GROUP_ELEMENTS, MEMO_WORDS = 100_000, 500_000
#: A chunk has about so many documents, or elements of sets, at most.
CHUNK_DOCS, CHUNK_ELEMENTS = 256, 400_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(elements: np.ndarray, draw: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(elements + np.uint64(draw) * _STEP) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash values (set, slot) of sets of 64-bit hashes; infinite for an empty set."""
    values = np.full((len(sets), slots), np.inf)
    if not sets:
        return values
    flat = values.reshape(-1)
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = None  # the permutations so far, a row for each element still at work
    for j in range(slots):
        if not len(elements):
            break
        fraction = _uniform(elements, 2 * j + 1)
        pick = j + (_uniform(elements, 2 * j + 2) * (slots - j)).astype(np.int64)
        if order is None:
            slot = pick
        else:
            rows = np.arange(len(elements))
            slot = order[rows, pick]
            order[rows, pick] = order[:, j]
            order[:, j] = slot
        np.minimum.at(flat, owner * slots + slot, fraction + j)
        open_ = ~(values.max(1) < j + 1)
        keep = open_[owner]
        if order is None:
            pick = pick[keep]
            order = np.tile(np.arange(slots, dtype=np.int16), (len(pick), 1))
            rows = np.arange(len(pick))
            order[rows, pick], order[:, 0] = order[:, 0].copy(), pick
        else:
            order = order[keep]
        elements, owner = elements[keep], owner[keep]
    return values


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key (set, band) for each band of the signatures."""
    bits = values.view(np.uint64).reshape(len(values), bands, -1)
    with np.errstate(over="ignore"):
        key = np.arange(bands, dtype=np.uint64)[None, :] * _STEP
        for r in range(bits.shape[2]):
            key = _mix(key ^ bits[:, :, r]) + _STEP
    return key.view(np.int64)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def shingles(text: str | bytes | None, size: int) -> set[bytes]:
    words = text.split() if isinstance(text, bytes) else words_of(text)
    if len(words) <= size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


class Hasher:
    """64-bit hashes of the shingles of a text, each distinct hash once, ascending."""

    def __init__(self, size: int):
        self.size, self.memo = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        return self.of(words_of(text))

    def of(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        memo = self.memo
        if not words:
            return np.zeros(0, np.uint64)
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in words:
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w)
        got = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        n = max(1, len(got) - self.size + 1)
        with np.errstate(over="ignore"):
            out = np.full(n, len(got) if len(got) < self.size else self.size, np.uint64)
            for i in range(min(self.size, len(got))):
                out = _mix(out * np.uint64(31) ^ got[i : i + n])
        return np.unique(out)


def node_of(words: list[bytes]) -> bytes | None:
    """The name of a word sequence in the graph: 128 bits of its BLAKE2b digest. Equal sequences have equal sets; all other pairs are compared."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def prepare(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, n_shingles, node, bands); node and bands are null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(size)
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                sets = [hasher(t) for t in texts]
                keys, start = [], 0
                while start < len(sets):
                    stop, total = start, 0
                    while stop < len(sets) and (stop == start or total + len(sets[stop]) <= GROUP_ELEMENTS):
                        total += len(sets[stop])
                        stop += 1
                    keys.append(band_keys(signatures(sets[start:stop])))
                    start = stop
                flat = np.concatenate(keys).reshape(-1)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(words_of(t)) for t in texts], pa.binary()), bands], names=["doc_id", "n_shingles", "node", "bands"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, node binary, bands array<long>")


def _texts_of(nodes: DataFrame, sets: DataFrame, docs: DataFrame, columns: str, convert) -> DataFrame:
    """Rows (node, *columns), one for each row of nodes (node, distinct): convert(words) of the node's words. Only documents that
    stand for a node are read; a row's own words tell which node it is, so rows of one doc_id with other texts aren't taken for it."""
    ids = stored(nodes.join(sets.select("node", "rep"), "node").select(F.col("rep").alias("doc_id")).distinct(), "node-ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    kinds = {"binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    name, kind = columns.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                found = [w for t in part.column(0).to_pylist() if (w := words_of(t))]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(w) for w in found], pa.binary()), pa.array([convert(w) for w in found], kinds[kind])], names=["node", name])

    got = stored(texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("text").mapInArrow(run, f"node binary, {columns}"), "node-texts")
    discard(ids)
    # Repeated rows of one document are one node.
    return got.dropDuplicates(["node"]) if got.count() > nodes.count() else got


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose full sets of shingles have an intersection of at least percent of the union."""
    pairs = stored(pairs, "pairs")
    nodes = stored(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct(), "pair-nodes")
    texts = _texts_of(nodes, sets, docs, "words binary", b" ".join)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[bytes, set[bytes]] = {}
        for batch in batches:
            good = []
            for a, b, wa, wb in zip(*(batch.column(c) for c in range(4))):
                a, b = a.as_py(), b.as_py()
                if a not in last:
                    last = {a: shingles(wa.as_py(), size)}
                sa, sb = last[a], shingles(wb.as_py(), size)
                both = len(sa & sb)
                if both and 100 * both >= percent * (len(sa) + len(sb) - both):
                    good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in good], pa.binary()) for i in (0, 1)], names=["a", "b"])

    left = pairs.join(texts.select(F.col("node").alias("b"), F.col("words").alias("words_b")), "b")
    both = left.join(texts.select(F.col("node").alias("a"), F.col("words").alias("words_a")), "a")
    out = stored(both.select("a", "b", "words_a", "words_b").mapInArrow(run, "a binary, b binary"), "links")
    for t in (pairs, nodes, texts):
        discard(t)
    return out


def joining_pairs(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, classes: list[int], percent: int) -> list[tuple[int, int]]:
    """Of all pairs of a set in first and a set in second (indexes) that are similar enough, one for each two classes it joins."""
    sizes = np.array([len(s) for s in sets])
    right = np.concatenate([sets[j] for j in second])
    holder = np.repeat(np.arange(len(second)), sizes[second])
    order = np.argsort(right, kind="stable")
    right, holder = right[order], holder[order]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = []
    for i in first.tolist():
        low, high = np.searchsorted(right, sets[i], "left"), np.searchsorted(right, sets[i], "right")
        n = high - low
        if not n.any():
            continue
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(holder[at], minlength=len(second))
        for j in second[100 * both >= percent * (sizes[i] + sizes[second] - both)].tolist():
            a, b = find(classes[i]), find(classes[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _between(rest: DataFrame, sets: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) that join components within a bucket; rest: (bucket, node, n, component, chunks)."""
    nodes = stored(rest.select("node").distinct(), "apart-nodes")
    hasher: list[Hasher] = []

    def hashed(words: list[bytes]) -> np.ndarray:
        if not hasher:
            hasher.append(Hasher(size))
        return hasher[0].of(words).view(np.int64)

    elements = _texts_of(nodes, sets, docs, "elements array<long>", hashed)
    mine = F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks")).cast("int")
    members = rest.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    members = members.select("node", "component", F.concat_ws(":", "bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("block"), (F.col("mine") > F.col("other")).alias("second"), (F.col("mine") == F.col("other")).alias("alone"))
    placed = members.join(elements, "node").select("block", "node", "component", "second", "alone", "elements")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs(batches):
            node, component = t.column("node").to_pylist(), t.column("component").to_pylist()
            number = {c: i for i, c in enumerate(dict.fromkeys(component))}
            if len(number) < 2:
                continue
            found = [np.sort(np.array(x.values.to_numpy(), np.int64).view(np.uint64)) for x in t.column("elements")]
            second = t.column("second").to_numpy(zero_copy_only=False).astype(bool)
            everyone = np.arange(len(node))
            one, two = (everyone, everyone) if t.column("alone")[0].as_py() else (everyone[~second], everyone[second])
            if len(one) and len(two):
                pairs = joining_pairs(found, one, two, [number[c] for c in component], percent)
                yield pa.RecordBatch.from_arrays([pa.array([min(node[i], node[j]) for i, j in pairs], pa.binary()), pa.array([max(node[i], node[j]) for i, j in pairs], pa.binary())], names=["a", "b"])

    out = stored(placed.repartition("block").sortWithinPartitions("block").mapInArrow(compare, "a binary, b binary").distinct(), "joining-pairs")
    for t in (nodes, elements):
        discard(t)
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of docs."""
    ready = stored(prepare(docs, size), "signatures")
    some = ready.where("n_shingles > 0 and doc_id is not null")
    sets = stored(some.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min_by("bands", "doc_id").alias("bands")), "sets")
    buckets = sets.select("node", "n", F.explode("bands").alias("bucket"))
    shared = stored(buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("members")).where("members > 1").drop("members"), "buckets")
    within = stored(buckets.join(shared, "bucket"), "bucket-members")
    # Two sets can only be that similar if their sizes are.
    near = lambda x, y: (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)
    hubs = within.where("node = hub").select("bucket", F.col("n").alias("hub_n"))
    first = within.where("node <> hub").join(hubs, "bucket").where(near("n", "hub_n")).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = verified(first, sets, docs, size, percent)
    # Rows of one doc_id with different texts are one document: their nodes are linked by it.
    several = stored(some.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("other")).where("a <> other").select("doc_id", "a"), "ids-of-several-texts")
    edges = links if several.isEmpty() else links.unionAll(some.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")))
    labels = components(edges)
    # What the hubs left apart: members of one bucket in different components.
    named = stored(within.join(labels, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component")), "bucket-components")
    apart = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members"), F.sum("n").alias("elements")).where("x <> y")
    apart = stored(apart.select("bucket", F.greatest(F.ceil(F.col("members") / CHUNK_DOCS), F.ceil(F.col("elements") / CHUNK_ELEMENTS)).cast("int").alias("chunks")), "buckets-apart")
    rest = stored(named.join(apart, "bucket"), "members-apart")
    if not rest.isEmpty():
        more = verified(_between(rest, sets, docs, size, percent), sets, docs, size, percent)
        if not more.isEmpty():
            labels = components(edges.unionAll(more))
    # The smallest doc_id of a component names it.
    placed = stored(sets.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component")), "placed-sets")
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_node = stored(placed.join(least, "component").select("node", "component_id"), "set-components")
    for t in (shared, within, named, apart, rest, several, placed, links):
        discard(t)
    out = ready.select("doc_id", "n_shingles", "node").join(by_node, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
