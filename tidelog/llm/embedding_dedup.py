"""Near-duplicate vectors by binary codes of a random rotation.

A unit vector u is rotated to Pu, and only the signs are kept, as packed bits x, beside the correction factor f = <x, Pu>. For another unit vector v, <x, Pv> / f is an
unbiased estimate of <u, v>, off by sqrt(1 - f^2) / f times a component of a random direction, which gives a confidence bound. So that no float is needed for it,
Pv is stored as well in 4-bit steps (with a fixed dither, which keeps the estimate unbiased) as four bit planes: <x, Pv> then is a few popcounts. Code, planes and factors are
computed once for each vector and stored. Pairs whose upper bound is below the threshold are done with; of the others the vectors themselves are fetched and
the cosine is computed exactly in double precision. Vectors are only compared in buckets of one label whose key is a group of bits of the code; the
number of bits grows with the number of vectors and the number of groups is set so that a pair at the threshold meets in none with a chance of MISS at most.

Equal vectors of a label are reduced to one with a count first. Buckets are cut into chunks of about CHUNK vectors, and a task compares two
chunks at a time: first by codes alone, which names the vectors that have an undecided pair in the block, then, for these alone, by vectors. A pair
counts in the first group of bits that it shares, so nothing is counted twice, and a block returns counts and a spanning forest, never its pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors without label, link with nothing; vectors of
different lengths aren't compared. Rows without vec_id link with nothing. Rows of one vec_id are one node; each row has the links of its own vector: n_links counts
other vec_ids, one for each distinct vector of theirs that is linked, and repeated rows once. Very large and very small components are scaled by a power of two first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, runs, stored

THRESHOLD, MISS, CHUNK, BOUND = 0.98, 1e-5, 512, 5.0
#: Bits of a code that serve the estimate at least, and bits of a step of the other vector.
LEAST_BITS, PLANES = 128, 4
SEED = 5


def plan(vectors: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits of a key, groups of bits) for so many vectors."""
    same = 1 - math.acos(threshold) / math.pi
    bits = min(28, max(5, round(math.log2(max(1, vectors) / 512))))
    return bits, math.ceil(math.log(MISS) / math.log1p(-(same**bits)))


def rotation(dim: int, bits: int) -> np.ndarray:
    """Rows of stacked random rotations, at least so many; divided so that the map keeps lengths."""
    rng = np.random.default_rng([SEED, dim])
    turns = -(-bits // dim)
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(turns)]) / math.sqrt(turns)


def scaled(raw: np.ndarray) -> np.ndarray:
    """Rows times a power of two (no digit changes), so that squares neither overflow nor vanish."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(1))[1][:, None])


def codes(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs as booleans, factors)."""
    turned = unit @ turn.T
    return turned > 0, np.abs(turned).sum(1) / math.sqrt(turn.shape[0])


def bit_keys(signs: np.ndarray, bits: int, groups: int) -> np.ndarray:
    """Keys (vector, group) of the first bits * groups signs; the group is part of the key."""
    weights = 1 << np.arange(bits, dtype=np.int64)
    return (signs[:, : bits * groups].reshape(len(signs), groups, bits) @ weights) * groups + np.arange(groups)


def estimate_bits(dim: int) -> int:
    """Bits of the code that serve the estimate: whole rotations."""
    return dim * -(-LEAST_BITS // dim)


def _words(bits: np.ndarray) -> np.ndarray:
    """Booleans (vector, n) packed into 64-bit words, padded with zeros."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


class Codes:
    """Codes of vectors of one length: signs (packed, all of them), planes of the rotated vector in steps, and three numbers (factor, low, step)."""

    def __init__(self, signs: np.ndarray, planes: np.ndarray, numbers: np.ndarray, dim: int):
        self.signs, self.planes, self.numbers, self.dim = signs, planes, numbers, dim

    @classmethod
    def of(cls, raw: np.ndarray, turn: np.ndarray) -> Codes:
        n, dim = raw.shape
        x = scaled(raw)
        unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        signs = unit @ turn.T > 0
        bits = estimate_bits(dim)
        turned = (unit @ turn[:bits].T) * math.sqrt(len(turn) / bits)
        factor = np.abs(turned).sum(1) / math.sqrt(bits)
        low = turned.min(1)
        step = np.maximum((turned.max(1) - low) / (2**PLANES - 1), 1e-30)
        dither = np.random.default_rng([SEED, 1]).random(bits)
        steps = np.clip(np.floor((turned - low[:, None]) / step[:, None] + dither), 0, 2**PLANES - 1).astype(np.uint8)
        planes = np.stack([_words(steps >> j & 1 > 0) for j in range(PLANES)], 1)
        return cls(np.packbits(signs, axis=1), planes, np.stack([factor, low, step], 1).astype(np.float32), dim)

    def blobs(self) -> pa.Array:
        flat = np.concatenate([self.signs, self.planes.reshape(len(self.signs), -1).view(np.uint8), self.numbers.view(np.uint8)], 1)
        n, width = flat.shape
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])

    @classmethod
    def read(cls, blobs: list[bytes], dim: int, turns: int) -> Codes:
        """turns: rows of the rotation."""
        flat = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
        signs, words = -(-turns // 8), -(-estimate_bits(dim) // 64)
        planes = np.ascontiguousarray(flat[:, signs : signs + PLANES * words * 8]).view(np.uint64).reshape(len(blobs), PLANES, words)
        return cls(flat[:, :signs], planes, np.ascontiguousarray(flat[:, signs + PLANES * words * 8 :]).view(np.float32), dim)

    def take(self, at: np.ndarray) -> Codes:
        return Codes(self.signs[at], self.planes[at], self.numbers[at], self.dim)

    def keys(self, bits: int, groups: int) -> np.ndarray:
        return bit_keys(np.unpackbits(self.signs, axis=1, count=bits * groups).astype(np.int64), bits, groups)

    def estimates(self, other: Codes) -> tuple[np.ndarray, np.ndarray]:
        """(estimates of the inner products (self, other), their slack) by popcounts."""
        bits = estimate_bits(self.dim)
        code = _words(np.unpackbits(self.signs, axis=1, count=bits).astype(bool))
        ones = np.bitwise_count(code).sum(1, dtype=np.int64)
        factor = self.numbers[:, 0].astype(float)
        low, step = other.numbers[:, 1].astype(float), other.numbers[:, 2].astype(float)
        inside, total = np.zeros((len(code), len(step))), np.zeros(len(step))
        for j in range(PLANES):
            both = sum(np.bitwise_count(code[:, None, w] & other.planes[None, :, j, w]).astype(np.int32) for w in range(code.shape[1]))
            inside += both * float(1 << j)
            total += np.bitwise_count(other.planes[:, j]).sum(1) * float(1 << j)
        product = (2 * (ones[:, None] * low + inside * step) - (bits * low + total * step)) / math.sqrt(bits)
        # The error is at most that of the part of the other vector that is orthogonal to the coded one, and that of the steps.
        off = np.maximum(1 - factor**2, 0)[:, None] / (bits - 1) + (step / 2) ** 2
        return product / factor[:, None], BOUND * np.sqrt(off) / factor[:, None]


def undecided(left: Codes, right: Codes | None, bits: int, groups: int, group: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of two chunks (or within one) whose upper bound reaches the threshold and whose first shared key is that of group."""
    estimate, slack = left.estimates(left if right is None else right)
    maybe = estimate + slack >= threshold
    a, b = np.nonzero(np.triu(maybe, 1) if right is None else maybe)
    if not len(a) or not group:
        return a, b
    left_keys = left.keys(bits, groups)[:, :group]
    right_keys = left_keys if right is None else right.keys(bits, groups)[:, :group]
    first = np.concatenate([~(left_keys[a[s : s + 50_000]] == right_keys[b[s : s + 50_000]]).any(1) for s in range(0, len(a), 50_000)])
    return a[first], b[first]


def exact(raw: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs have a cosine of at least the threshold."""
    x = scaled(raw)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    parts = [np.einsum("ij,ij->i", x[a[s : s + 50_000]], x[b[s : s + 50_000]]) / (norm[a[s : s + 50_000]] * norm[b[s : s + 50_000]]) >= threshold for s in range(0, len(a), 50_000)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Union-find over n nodes: the root of each, the smallest index of its class."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def block_pairs(codes: Codes, second: np.ndarray, bits: int, groups: int, group: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """undecided() of a block: between its two chunks, or within its only one."""
    if not second.any():
        return undecided(codes, None, bits, groups, group, threshold)
    one, two = np.nonzero(~second)[0], np.nonzero(second)[0]
    if not len(one):
        return one, one
    a, b = undecided(codes.take(one), codes.take(two), bits, groups, group, threshold)
    return one[a], two[b]


def links(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row (vec_id, embedding, label) of vectors."""
    raw = F.col("embedding").cast("array<double>")
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(raw) > 0) & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(raw, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), raw.alias("raw"), F.coalesce(sound, F.lit(False)).alias("sound"))
    # A copy has an equal vector; 128 bits of two hashes and the length stand for the vector.
    key = F.when(F.col("sound"), F.struct(F.col("label").cast("string").alias("label"), F.size("raw").alias("dim"), F.xxhash64("label", "raw").alias("h1"), F.xxhash64(F.lit(7), F.col("label"), F.col("raw")).alias("h2")))
    rows = rows.select("vec_id", "raw", key.alias("key"))
    # Repeated rows of one vec_id count once.
    named = rows.where("key is not null").groupBy("key", "vec_id").agg(F.first("raw").alias("raw"))
    reps = stored(named.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min_by("raw", "vec_id").alias("raw")), "vectors")
    bits, groups = plan(reps.count(), threshold)
    long_enough = lambda dim: rotation(dim, max(bits * groups, estimate_bits(dim)))

    # r names a vector: of two vectors of one vec_id the hashes tell which is meant.
    mark = F.struct(F.col("rep").alias("id"), F.col("key.h1").alias("h1"), F.col("key.h2").alias("h2")).alias("r")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            raw = batch.column(batch.num_columns - 1)
            dims = np.array([len(x) for x in raw])
            flat = raw.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(dims)])
            for dim in sorted(set(dims.tolist())):
                turn = turns.setdefault(dim, long_enough(dim))
                at = np.nonzero(dims == dim)[0]
                made = Codes.of(np.stack([flat[starts[i] : starts[i] + dim] for i in at]), turn)
                keys = made.keys(bits, groups)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made.blobs(), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * groups), pa.array(keys.reshape(-1)))], names=["r", "label", "dim", "code", "keys"])

    name = "struct<id:bigint,h1:bigint,h2:bigint>"
    codes_of = stored(reps.select(mark, F.col("key.label").alias("label"), F.col("key.dim").alias("dim"), "raw").mapInArrow(coded, f"r {name}, label string, dim int, code binary, keys array<long>"), "codes")
    # The keys alone find the buckets; codes follow into shared buckets, and vectors to undecided pairs only.
    opened = codes_of.select("r", "label", "dim", F.explode("keys").alias("bucket"))
    sizes = stored(opened.groupBy("label", "dim", "bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    members = opened.join(sizes, ["label", "dim", "bucket"])
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64("r.id", F.lit(3)), F.col("chunks")).cast("int")
    members = members.withColumn("chunks", chunks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    members = members.select("r", "dim", F.concat_ws(":", "label", "dim", "bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("block"), (F.col("bucket") % groups).cast("int").alias("grp"), (F.col("mine") > F.col("other")).alias("second"))
    placed = members.join(codes_of.select("r", "code"), "r").select("block", "dim", "grp", "r", "second", "code")

    def read(t: pa.Table) -> tuple[Codes, np.ndarray, int]:
        dim = t.column("dim")[0].as_py()
        codes = Codes.read(t.column("code").to_pylist(), dim, dim * -(-max(bits * groups, estimate_bits(dim)) // dim))
        return codes, t.column("second").to_numpy(zero_copy_only=False).astype(bool), t.column("grp")[0].as_py()

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs(batches):
            if t.num_rows > 1:
                a, b = block_pairs(*read(t)[:2], bits, groups, t.column("grp")[0].as_py(), threshold)
                if len(a):
                    yield from t.take(pa.array(np.unique(np.concatenate([a, b])))).combine_chunks().to_batches()

    shape = f"block string, dim int, grp int, r {name}, second boolean, code binary"
    open_ = stored(placed.repartition("block").sortWithinPartitions("block").mapInArrow(screen, shape), "undecided")
    near = open_.join(reps.select(mark, "copies", "raw"), "r").select("block", "dim", "grp", "r", "second", "code", "copies", "raw")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            kind = pa.struct([("id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())], names=["a", "n", "b"])

        found: list[tuple] = []
        for _, t in runs(batches):
            t = t.take(pa.array(np.argsort(t.column("r").combine_chunks().field("id").to_numpy(), kind="stable")))
            codes, second, group = read(t)
            raw = t.column("raw").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            a, b = block_pairs(codes, second, bits, groups, group, threshold)
            good = exact(raw, a, b, threshold)
            a, b, copies, names = a[good], b[good], t.column("copies").to_numpy(), t.column("r").to_pylist()
            n = np.bincount(a, copies[b], t.num_rows) + np.bincount(b, copies[a], t.num_rows)
            root = _forest(t.num_rows, a, b)
            found += [(names[i], int(n[i]), names[root[i]]["id"]) for i in np.nonzero(n)[0]]
            if len(found) > 20_000:
                yield batch_of(found)
                found = []
        yield batch_of(found)

    found = stored(near.repartition("block").sortWithinPartitions("block").mapInArrow(compare, f"a {name}, n long, b long"), "vector-links")
    edges = found.select(F.col("a.id").alias("a"), "b")
    several = named.groupBy("vec_id").agg(F.count("*").alias("k")).where("k > 1").select("vec_id")
    if not several.isEmpty():
        own = named.join(several, "vec_id", "left_semi").select("vec_id", "key")
        edges = edges.unionAll(own.join(reps.select("key", "rep"), "key").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    labels = components(edges)
    summed = found.groupBy(F.col("a").alias("r")).agg(F.sum("n").alias("n"))
    classes = reps.select("key", mark, "rep", "copies").join(summed, "r", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    classes = stored(classes.select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vector-classes")
    for t in (sizes, open_, found):
        discard(t)
    out = rows.select("vec_id", "key").join(classes, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
