"""Language-model scores by prediction by partial matching (PPM) over bytes.

A text is its words (A-Z lower-cased) with single spaces between and an end mark; ORDER end marks stand before it, so that every byte has a context of
ORDER bytes. Contexts run across words over the whole document. The model is a trie of the byte contexts of all training documents. A byte is predicted in the longest
context seen; if it isn't among the context's symbols, the model escapes to the next shorter one with the estimate symbols / (occurrences + symbols)
(method C) and leaves out all symbols already ruled out. Below order 0 the remaining byte values are equally likely. The code length of a text is the sum over its bytes.

The trie is a table for each order: rows (gram, n), a gram being a context and its symbol. A byte's price depends on its gram of ORDER + 1 bytes alone, so each distinct
gram of the corpus is priced once, by joins down the orders, and a document sums the prices of its bytes. All tables lie in the shared folder
and are joined by key; they grow with the corpus, and nothing is cut at any size. The most frequent grams and words (HOT_GRAMS and HOT_WORDS at most)
are broadcast as a shortcut, all others are joined to the tables, with equal results.

Defined results: a null or empty text is the end mark alone. Rows without doc_id are held out. Repeated rows give repeated results; further
columns, of whatever name, have no part. Without training documents every byte costs log10(256). adaptive_bits() gives the adaptive mode for one text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, stored

#: A gram of ORDER + 1 bytes (7 at most) is a positive long.
ORDER = 5
HOT_GRAMS, HOT_WORDS = 1_500_000, 200_000
FLUSH_WORDS, FLUSH_GRAMS, FLUSH_BYTES = 150_000, 1_300_000, 1_000_000
FOLDS, HELD_OUT = 7, 2
END = b"\n"  # can't be a word


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def grams(spelled: list[bytes], order: int = ORDER) -> np.ndarray:
    """The grams of all bytes of the texts (each with its end mark), one text behind the other."""
    data = b"".join(END * order + s for s in spelled) + bytes(7)
    sizes = np.array([len(s) for s in spelled], np.int64)
    windows = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))
    if not len(sizes):
        return np.zeros(0, np.int64)
    own = np.arange(sizes.sum())
    own += np.repeat(np.arange(len(sizes)) * order, sizes)
    keys = windows[own].astype(np.uint64)
    keys >>= np.uint64(8 * (7 - order))
    return keys.view(np.int64)


def adaptive_bits(text: str | None, order: int = 3) -> float:
    """The adaptive code length in bits of one text by bytes: each byte is coded, then learned."""
    data = (text or "").encode()
    counts: dict[bytes, Counter] = {}
    bits = 0.0
    for i, symbol in enumerate(data):
        ruled_out: set[int] = set()
        for k in range(min(order, i), -1, -1):
            node = counts.get(data[i - k : i])
            if not node:
                continue
            left = {s: c for s, c in node.items() if s not in ruled_out}
            total, fresh = sum(left.values()), len(left)
            if symbol in left:
                bits -= np.log2(left[symbol] / (total + fresh))
                break
            if fresh:
                bits -= np.log2(fresh / (total + fresh))
            ruled_out |= node.keys()
        else:
            bits += np.log2(256 - len(ruled_out))
        for k in range(min(order, i) + 1):
            counts.setdefault(data[i - k : i], Counter())[symbol] += 1
    return float(bits)


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def count(docs: DataFrame) -> DataFrame:
    """Rows (word, gram, n), one of word and gram being null, of all words and grams of docs (doc_id, text); n counts in training documents only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, others = Counter(), set()
        waiting: dict[bool, list[bytes]] = {True: [], False: []}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def learn() -> None:
            nonlocal size
            for training, spelled in waiting.items():
                if spelled:
                    keys, n = np.unique(grams(spelled), return_counts=True)
                    held.append((keys, n.astype(np.int32) if training else np.zeros(len(n), np.int32)))
                    spelled.clear()
            size = 0
            if sum(len(k) for k, _ in held) > 2 * FLUSH_GRAMS:
                merge()

        def merge() -> None:
            if len(held) > 1:
                keys, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
                held.clear()
                order = np.argsort(keys, kind="stable")
                keys, n = keys[order], n[order]
                del order
                first = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0]
                held.append((keys[first], np.add.reduceat(n, first)))

        def batch_of(w: list[bytes], g: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            none = len(w) or len(g)
            columns = [pa.array(w, pa.binary()), pa.nulls(none, pa.int64())] if w else [pa.nulls(none, pa.binary()), pa.array(g)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], names=["word", "gram", "n"])

        def out_words() -> Iterator[pa.RecordBatch]:
            found = list(words.items()) + [(w, 0) for w in others.difference(words)]
            for s in range(0, len(found), 100_000):
                part = found[s : s + 100_000]
                yield batch_of([w for w, _ in part], np.zeros(0), np.array([c for _, c in part]))
            words.clear()
            others.clear()

        def out_grams() -> Iterator[pa.RecordBatch]:
            merge()
            for keys, n in held:
                for s in range(0, len(keys), 100_000):
                    yield batch_of([], keys[s : s + 100_000], n[s : s + 100_000])
            held.clear()

        for batch in batches:
            for part in slices(batch, 1, max_bytes=1_000_000):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = words_of(text)
                    spelled = b" ".join(found) + END
                    training = not is_held_out(doc_id)
                    found.append(END)
                    (words if training else others).update(found)
                    waiting[training].append(spelled)
                    size += len(spelled)
                if size > FLUSH_BYTES:
                    learn()
                if len(words) + len(others) > FLUSH_WORDS:
                    yield from out_words()
                if held and len(held[0][0]) > FLUSH_GRAMS:
                    yield from out_grams()
        learn()
        yield from out_words()
        yield from out_grams()

    return docs.mapInArrow(run, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def _tail(gram: Column, k: int) -> Column:
    """A gram's context of k bytes and symbol."""
    return gram.bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1))


def _small(df: DataFrame, bytes_in_key: int) -> DataFrame:
    """Tables whose key has two bytes at most have 65,536 rows at most and are broadcast."""
    return F.broadcast(df) if bytes_in_key <= 2 else df


def trie(learned: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """The tables (gram, n) of orders 0 to order, from that of the highest."""
    tables = [stored(learned, "trie")]
    for k in range(order - 1, -1, -1):
        tables.insert(0, stored(tables[0].groupBy(_tail(F.col("gram"), k).alias("gram")).agg(F.sum("n").alias("n")), "trie"))
    return tables


def contexts(tables: list[DataFrame], k: int) -> DataFrame:
    """Rows (ctx, total, symbols, below) of the contexts of k bytes; below: the occurrences that the symbols have in the next shorter context."""
    found = tables[k].withColumn("low", F.lit(0).cast("long"))
    if k:
        lower = tables[k - 1].select(F.col("gram").alias("tail"), F.col("n").alias("lower"))
        found = tables[k].withColumn("tail", _tail(F.col("gram"), k - 1)).join(_small(lower, k), "tail").withColumn("low", F.col("lower"))
    return found.groupBy(F.shiftright("gram", 8).alias("ctx")).agg(F.sum("n").alias("total"), F.count("*").alias("symbols"), F.sum("low").alias("below"))


def prices(tables: list[DataFrame], fresh: DataFrame) -> DataFrame:
    """Rows (gram, n, price): the log10 probability of the symbol of each gram, of those in the highest table and of those of fresh (gram), which aren't there."""
    top = len(tables) - 1
    ctx = contexts(tables, top)
    seen = tables[top].withColumn("ctx", F.shiftright("gram", 8)).join(ctx, "ctx").select("gram", "n", (F.log10("n") - F.log10(F.col("total") + F.col("symbols"))).alias("price"))
    zero = F.lit(0).cast("long")
    state = fresh.select("gram", F.lit(0.0).alias("price"), zero.alias("out_symbols"), zero.alias("out_total"), F.lit(False).alias("done"))
    for k in range(top, -1, -1):
        ctx = contexts(tables, k) if k < top else ctx
        state = state.withColumn("tail", _tail(F.col("gram"), k)).withColumn("ctx", F.shiftright("tail", 8)).join(_small(ctx, k), "ctx", "left")
        hits = tables[k].select(F.col("gram").alias("tail"), "n")
        state = state.join(_small(hits, k + 1), "tail", "left") if k < top else state.withColumn("n", F.lit(None).cast("long"))
        # What the longer context held is ruled out here.
        state = state.withColumn("left_total", F.col("total") - F.col("out_total")).withColumn("left_symbols", F.col("symbols") - F.col("out_symbols"))
        whole = F.log10(F.col("left_total") + F.col("left_symbols"))
        known, hit = F.col("total").isNotNull() & ~F.col("done"), F.col("n").isNotNull()
        step = F.when(known & hit, F.log10("n") - whole).when(known & (F.col("left_symbols") > 0), F.log10("left_symbols") - whole).otherwise(0.0)
        state = state.select(
            "gram",
            (F.col("price") + step).alias("price"),
            F.when(known, F.col("symbols")).otherwise(F.col("out_symbols")).alias("out_symbols"),
            F.when(known, F.col("below")).otherwise(F.col("out_total")).alias("out_total"),
            (F.col("done") | (known & hit)).alias("done"),
        )
    price = F.col("price") - F.when(F.col("done"), 0.0).otherwise(F.log10(F.lit(256) - F.col("out_symbols")))
    return seen.unionAll(state.select("gram", F.lit(0).cast("long").alias("n"), price.alias("price")))


def _hot_from(table: DataFrame, most: int) -> int:
    """The least n such that at most that many rows have it or more, by a histogram of 16 steps to a doubling."""
    steps = table.groupBy(F.floor(16 * F.log2(F.greatest("n", F.lit(1)))).alias("step")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).collect()
    rows, least = 0, (1 << 62)
    for r in sorted(steps, key=lambda r: -r["step"]):
        rows += r["rows"]
        if rows > most:
            break
        least = r["least"]
    return least


_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so multiplication by it loses nothing


class PriceTable:
    """Prices of grams, sorted by the grams' hashes (hashed()), with the first place of each value of their top bits: little more memory than the entries have."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        self.hashes, self.values = np.append(hashes, np.uint64(2**64 - 1)), np.append(values, np.nan)
        self.shift = np.uint64(64 - max(1, len(hashes)).bit_length())
        self.start = np.searchsorted(hashes >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)

    @staticmethod
    def hashed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = keys.view(np.uint64) * _STEP
        order = np.argsort(hashes)
        return hashes[order], values[order]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values, NaN for keys that aren't there."""
        want = keys.view(np.uint64) * _STEP
        at = self.start[want >> self.shift]
        there = self.hashes[at]
        left = np.nonzero(there < want)[0]
        while len(left):
            at[left] += 1
            there[left] = self.hashes[at[left]]
            left = left[there[left] < want[left]]
        out = self.values[at]
        out[there != want] = np.nan
        return out


def _gram_key(gram: Column) -> Column:
    return F.concat(F.lit(b"g"), F.unhex(F.lpad(F.hex(gram), 14, "0")))


def score(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = stored(count(docs), "counts")
    vocabulary = counted.where("word is not null").select("word", "n")
    total, kinds = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    found = counted.where("gram is not null").select("gram", "n")
    tables = trie(found.where("n > 0"))
    priced = stored(prices(tables, found.where("n = 0").select("gram")), "prices")
    word_from, gram_from = _hot_from(vocabulary, HOT_WORDS), _hot_from(priced, HOT_GRAMS)
    hot_words = vocabulary.where(F.col("n") >= word_from).toArrow()
    hot_grams = priced.where(F.col("n") >= gram_from).select("gram", "price").toArrow()
    hot = spark.sparkContext.broadcast((hot_words.column("word").to_pylist(), hot_words.column("n").to_numpy(), *PriceTable.hashed(hot_grams.column("gram").to_numpy(), hot_grams.column("price").to_numpy())))
    cold = vocabulary.where(F.col("n") < word_from).select(F.concat(F.lit(b"w"), F.col("word")).alias("key"), F.col("n").alias("c"), F.lit(None).cast("double").alias("price"))
    cold = cold.unionAll(priced.where(F.col("n") < gram_from).select(_gram_key(F.col("gram")).alias("key"), F.lit(None).cast("long").alias("c"), "price"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, keys, values = hot.value
        index, table = {w: i for i, w in enumerate(words)}, PriceTable(keys, values)
        columns = np.stack([counts > 0, np.log10(counts + 1.0)])
        for batch in batches:
            for part in slices(batch, 1, max_bytes=1_000_000):
                ids, texts = part.column(0), part.column(1).to_pylist()
                marks, spelled, sums, sizes, cold_words, tfs, owners = [], [], [], [], [], [], []
                for i, text in enumerate(texts):
                    tokens = words_of(text)
                    spelled.append(b" ".join(tokens) + END)
                    tokens.append(END)
                    marks.append(zlib.crc32((text or "").encode()))
                    known = np.fromiter((j for w in tokens if (j := index.get(w)) is not None), np.int64)
                    rest = Counter(w for w in tokens if w not in index)
                    cold_words += rest
                    tfs += rest.values()
                    owners += [i] * len(rest)
                    sums.append(columns[:, known].sum(1))
                    sizes.append(len(tokens))
                all_grams = grams(spelled)
                length = np.array([len(s) for s in spelled])
                price = table.find(all_grams)
                missing = np.nonzero(np.isnan(price))[0]
                price[missing] = 0.0
                document = np.repeat(np.arange(len(texts)), length)[missing]
                order = np.lexsort((all_grams[missing], document))
                document, lone = document[order], all_grams[missing][order]
                first = np.nonzero(np.append(True, (lone[1:] != lone[:-1]) | (document[1:] != document[:-1])))[0][: len(lone)]
                times = np.diff(np.append(first, len(lone)))
                document, lone = document[first], lone[first]
                # The row for the document itself has a key that no word or gram has, and a place of its own in the join.
                n = len(texts)
                own = [b" %d %d" % (d or 0, m) for d, m in zip(ids.to_pylist(), marks)]
                coded = (lone.view(np.uint64) | np.uint64(ord("g") << 56)).astype(">u8").tobytes()
                coded = pa.Array.from_buffers(pa.binary(), len(lone), [None, pa.py_buffer(np.arange(len(lone) + 1, dtype=np.int32) * 8), pa.py_buffer(coded)])
                key = pa.concat_arrays([pa.array(own, pa.binary()), pa.array([b"w" + w for w in cold_words], pa.binary()), coded])
                owner = np.concatenate([np.arange(n), np.array(owners, np.int64), document]).astype(np.int64)
                more = len(owner) - n
                zeros = np.zeros(more)
                sums = np.stack(sums, 1)
                starts = np.cumsum(length) - length
                padded = lambda x, kind: pa.array(np.concatenate([x, zeros]).astype(kind))
                tf = np.concatenate([np.zeros(n), np.array(tfs, float), times]).astype(np.int64)
                out = [ids.take(pa.array(owner)), pa.array(np.array(marks, np.int64)[owner]), padded(np.ones(n), np.int64), key, pa.array(tf), padded(np.array(sizes), np.int64), padded(sums[0], np.int64), padded(sums[1], float), padded(np.add.reduceat(price, starts), float)]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "mark", "whole", "key", "tf", "n", "known", "base", "own"])

    rows = docs.mapInArrow(split, "doc_id long, mark long, whole long, key binary, tf long, n long, known long, base double, own double")
    joined = rows.join(cold, "key", "left")
    or0 = lambda c: F.coalesce(c, F.lit(0))
    summed = joined.groupBy("doc_id", "mark").agg(
        F.sum("whole").alias("copies"),
        F.sum("n").alias("n"),
        F.sum(F.col("known") + F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known"),
        F.sum(F.col("base") + or0(F.col("tf") * F.log10(F.col("c") + 1.0))).alias("base"),
        F.sum(F.col("own") + or0(F.col("tf") * F.col("price"))).alias("own"),
    )
    # Rows of one doc_id and one text were summed together.
    each = lambda c: F.col(c) / F.col("copies")
    out = summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    for t in tables:
        discard(t)
    return out.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True)).alias("held_out"),
        each("n").cast("long").alias("n_tokens"),
        each("known").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (each("base") - each("n") * F.lit(math.log10(total + kinds + 1))).alias("base_score"),
        each("own").alias("score"),
    )
