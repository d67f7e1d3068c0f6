"""Token-id files: each document's ids compressed by themselves with a shared zstandard dictionary.

A file is a row of blocks. A block holds consecutive documents:

    magic "TIDS" | version u16 | reserved u16 | documents u32 | tokens u64 | frame bytes u64 | SHA-256 of the dictionary (32 bytes)
    frames       one zstandard frame per document, of ids as little-endian u16 (u32 in version 2)
    index        per document: doc_id i64, 1 if doc_id is null u8, frame offset u64, frame length u32, tokens u32
    index CRC-32 u32 | "\n"

The index gives any document by reading one frame. Files are named by partition, partitions are ranges of doc_id, and blocks and
documents ascend (null ids first), so that names and indexes together give the order of all documents. The dictionary lies beside
the files as a table of one row and is checked by its hash.

Defined results: a null or empty text is a document of the end id alone; repeated doc_ids are separate documents; an empty table gives no documents; further columns, of
whatever name, have no part.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, stored, work_path

MAGIC, HEAD, ENTRY = b"TIDS", struct.Struct("<4sHHIQQ32s"), struct.Struct("<qBQII")
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 4096
#: The dictionary is trained on a bounded sample: so many documents (those of least hash of doc_id; twice as many where ids repeat), of each the first so many tokens. It has
#: a part in the files' size only, never in their content.
DICTIONARY_DOCS, DICTIONARY_TOKENS, DICTIONARY_BYTES = 1000, 4096, 64 << 10
LEVEL = 3
MEMO_WORDS = 500_000
MARK, MARKED_WORDS = "0", 100


class WordCoder:
    """Ids of whole texts by a tokenizer that drops ASCII white space and never joins across it: each word between is encoded once
    by the library and remembered. The memory has two generations, so that words in use survive when it is emptied."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks themselves are parallel
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.mark = self._mark()
        self._probe()
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def _ids(self, texts: list[str], tokenizer=None) -> list[list[int]]:
        return [e.ids for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _mark(self) -> int | None:
        """The id of MARK, if it is one token that stands by itself between words."""
        mark, a, b, all_ = self._ids([MARK, "a", "b", f"a {MARK} b"])
        return mark[0] if len(mark) == 1 and all_ == a + mark + b else None

    def _probe(self) -> None:
        """Finds out what holds for this tokenizer: letters' case is nothing (folds), punctuation behind a letter is a word of its own (splits), and
        words of a-z need neither normalizer nor pre-tokenizer (lean, a tokenizer without them). What doesn't hold isn't used."""
        import random

        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        rng = random.Random(0)
        words = ["".join(rng.choice("etaoinshrdlucmbq") for _ in range(rng.randint(1, 14))) for _ in range(300)]
        tails = ["".join(rng.choice(",.;:!?") for _ in range(rng.randint(1, 3))) for _ in words]
        plain = self._ids(words)
        self.folds = self._ids([w.title() for w in words]) == plain == self._ids([w.upper() for w in words])
        self.splits = self._ids([w + t for w, t in zip(words, tails)]) == [a + b for a, b in zip(plain, self._ids(tails))]
        self.lean = Tokenizer.from_str(self.tokenizer.to_str())
        self.lean.normalizer, self.lean.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        same = self.mark is not None and self._ids([" ".join(words)], self.lean) == [[i for ids in plain for i in ids]] and self._ids([MARK], self.lean) == [[self.mark]]
        if not same:
            self.lean = None

    def _parts(self, word: bytes) -> tuple[bytes, bytes]:
        """(stem, tail) whose ids together are those of the word; (word, b"") where no rule applies."""
        stem, tail = word, b""
        if self.splits and word[-1] in b",.;:!?":
            cut = word.rstrip(b",.;:!?")
            # The stem ends with a letter: a-z, or one of the Latin-1 letters from sharp s on.
            if cut and (cut[-1:].isalpha() or (cut[-2:-1] == b"\xc3" and 0x9F <= cut[-1] <= 0xBF and cut[-1] != 0xB7)):
                stem, tail = cut, word[len(cut) :]
        if self.folds and stem.isalpha():
            stem = stem.lower()
        return stem, tail

    def _learn(self, words: list[bytes]) -> None:
        """Encodes new words: many at a time with a mark between, as calls cost more than words. Words that hold the mark go by themselves."""
        if self.lean is not None:
            lean = [w for w in words if w.isalpha() and w.islower()]
            self._learn_with(self.lean, lean)
            words = [w for w in words if not (w.isalpha() and w.islower())]
        self._learn_with(self.tokenizer, words)

    def _learn_with(self, tokenizer, words: list[bytes]) -> None:
        import numpy as np

        memo, alone = self.memo, words
        if self.mark is not None:
            sign = MARK.encode()
            alone, joint = [w for w in words if sign in w], [w for w in words if sign not in w]
            for i in range(0, len(joint), MARKED_WORDS):
                part = joint[i : i + MARKED_WORDS]
                ids = np.array(self._ids([(b" %s " % sign).join(part).decode()], tokenizer)[0], self.kind)
                cuts = np.nonzero(ids == self.mark)[0].tolist()
                if len(cuts) != len(part) - 1:
                    alone += part
                    continue
                raw, width, start = ids.tobytes(), ids.itemsize, 0
                for w, cut in zip(part, [*cuts, len(ids)]):
                    memo[w] = raw[width * start : width * cut]
                    start = cut + 1
        for i in range(0, len(alone), 20_000):
            part = alone[i : i + 20_000]
            for w, ids in zip(part, self._ids([w.decode() for w in part])):
                memo[w] = np.array(ids, self.kind).tobytes()

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        import numpy as np

        if len(self.memo) > MEMO_WORDS:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        split = [t.encode().split() for t in texts]
        missing: dict[bytes, None] = {}
        compound = []

        def need(w: bytes) -> None:
            if w not in memo:
                known = older.get(w)
                if known is None:
                    missing[w] = None
                else:
                    memo[w] = known

        for w in set().union(*split).difference(memo):
            known = older.get(w)
            if known is not None:
                memo[w] = known
                continue
            stem, tail = self._parts(w)
            if stem == w:
                missing[w] = None
                continue
            need(stem)
            if tail:
                need(tail)
            compound.append((w, stem, tail))
        self._learn(list(missing))
        for w, stem, tail in compound:
            memo[w] = memo[stem] + memo[tail] if tail else memo[stem]
        end = np.array([end_id], self.kind).tobytes()
        return [b"".join(map(memo.__getitem__, words)) + end for words in split]


_coders: dict[str, WordCoder] = {}


def _coder(key: str, text) -> WordCoder:
    if key not in _coders:
        _coders.clear()
        _coders[key] = WordCoder(text.value)
    return _coders[key]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of serialized id arrays; where they are too few to train on, the arrays themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _zstd_dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def pack_block(documents: list[tuple[int | None, bytes, bytes]], width: int, dictionary_hash: bytes) -> bytes:
    """documents: (doc_id, raw ids, frame)."""
    frames = b"".join(d[2] for d in documents)
    index, at = [], 0
    for doc_id, raw, frame in documents:
        index.append(ENTRY.pack(doc_id or 0, doc_id is None, at, len(frame), len(raw) // width))
        at += len(frame)
    index = b"".join(index)
    head = HEAD.pack(MAGIC, 1 if width == 2 else 2, 0, len(documents), sum(len(d[1]) // width for d in documents), len(frames), dictionary_hash)
    return head + frames + index + struct.pack("<I", zlib.crc32(index)) + b"\n"


def read_blocks(data: bytes, dictionary_hash: bytes) -> Iterator[tuple[int, int, list[tuple[int | None, int, int, int]]]]:
    """(ids' width, tokens, [(doc_id, frame start in data, frame length, tokens)]) of each block."""
    at = 0
    while at < len(data):
        magic, version, _, n, tokens, size, said = HEAD.unpack_from(data, at)
        if magic != MAGIC or said != dictionary_hash:
            raise ValueError("not a block of this dictionary")
        start = at + HEAD.size
        index = data[start + size : start + size + n * ENTRY.size]
        end = start + size + len(index)
        if struct.unpack_from("<I", data, end)[0] != zlib.crc32(index) or data[end + 4 : end + 5] != b"\n":
            raise ValueError("broken index")
        yield 2 if version == 1 else 4, tokens, [(None if null else doc_id, start + off, length, m) for doc_id, null, off, length, m in ENTRY.iter_unpack(index)]
        at = end + 5


def _range(value: Column, bounds: list[int], low: int, high: int) -> Column:
    """How many of the ascending bounds[low:high] lie at or below value, plus low; null counts as below all. A balanced tree of comparisons."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(value >= bounds[middle], _range(value, bounds, middle + 1, high)).otherwise(_range(value, bounds, low, middle))


def write_token_files(docs: DataFrame, tokenizer_json: str, path: str, end_id: int = 2) -> bytes:
    """Writes the ids of every text of docs (doc_id, text) in ascending doc_id order under path/files, the dictionary under
    path/dictionary; returns the dictionary."""
    spark = docs.sparkSession
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    text = spark.sparkContext.broadcast(tokenizer_json)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = F.xxhash64("doc_id")
    bound = source.select(hashed.alias("h")).orderBy("h").limit(DICTIONARY_DOCS).agg(F.max("h")).first()[0]
    chosen = source.where(hashed <= bound).select(F.substring("text", 1, 8 * DICTIONARY_TOKENS).alias("text")).limit(2 * DICTIONARY_DOCS).collect() if bound is not None else []
    coder = WordCoder(tokenizer_json)
    width = 2 if coder.kind == "<u2" else 4
    dictionary = train_dictionary([x[: width * DICTIONARY_TOKENS] for x in coder.encode([r[0] or "" for r in chosen], end_id)])
    dictionary_hash = hashlib.sha256(dictionary).digest()
    kept = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder = _coder(key, text)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_zstd_dictionary(kept.value), write_content_size=True)
        held, size = [], 0
        block = lambda: pa.RecordBatch.from_arrays([pa.array([pack_block(held, width, dictionary_hash)[:-1]], pa.binary())], names=["block"])
        for batch in batches:
            for part in slices(batch, 1, max_bytes=2_000_000):
                ids = coder.encode([t or "" for t in part.column(1).to_pylist()], end_id)
                for doc_id, raw in zip(part.column(0).to_pylist(), ids):
                    held.append((doc_id, raw, packer.compress(raw)))
                    size += len(held[-1][2])
                    if size >= BLOCK_BYTES or len(held) >= BLOCK_DOCS:
                        yield block()
                        held, size = [], 0
        if held:
            yield block()

    # Bounds come from the ids alone: repartitionByRange would read every text once more to sample it.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(source.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    ordered = source.repartitionById(parts, _range(F.col("doc_id"), [int(b) for b in bounds], 0, len(bounds))).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    blocks = ordered.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value"))
    blocks.write.option("lineSep", "\n").option("maxRecordsPerFile", 16).text(f"{path}/files")
    spark.createDataFrame([(dictionary_hash.hex(), bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    return dictionary


def load_dictionary(spark: SparkSession, path: str) -> bytes:
    said, data = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(data).hexdigest() != said:
        raise ValueError("the dictionary differs from its hash")
    return bytes(data)


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32, ids) in the files' order by start. start counts the ids of all documents before."""
    dictionary = load_dictionary(spark, path)
    kept = spark.sparkContext.broadcast(dictionary)
    dictionary_hash = hashlib.sha256(dictionary).digest()
    files = spark.read.format("binaryFile").load(f"{path}/files").select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        unpacker = zstandard.ZstdDecompressor(dict_data=_zstd_dictionary(kept.value))
        for batch in batches:
            for i in range(batch.num_rows):
                file, at, data = batch.column(0)[i].as_py(), 0, batch.column(1)[i].as_py()
                for width, _, entries in read_blocks(data, dictionary_hash):
                    out: list[tuple] = []
                    for doc_id, start, length, n in entries:
                        raw = unpacker.decompress(data[start : start + length], max_output_size=n * width)
                        full = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                        out.append((file, doc_id, at, n, zlib.crc32(full), full if ids else None))
                        at += n
                    columns = list(zip(*out)) or [()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["file", "doc_id", "place", "n_tokens", "ids_crc32", "ids"])

    read = files.mapInArrow(run, "file string, doc_id long, place long, n_tokens long, ids_crc32 long, ids binary")
    read = read if ids else stored(read.drop("ids"), "token-index")  # small without the ids, so the files are read once
    # The ids before a file: those of the files before it in its part, and of the parts before. The sums over parts are a row for each.
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("long")
    totals = read.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", "n", number(r"part-(\d+)-[^/]*$").alias("part"), number(r"part-\d+-[^/]*-c(\d+)[^/]*$").alias("c"))
    totals = stored(totals, "token-totals")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("first"))
    begins = totals.join(parts, "part").select("file", (F.col("first") + F.coalesce(F.sum("n").over(before.partitionBy("part").orderBy("c")), F.lit(0))).alias("begin"))
    return read.join(begins, "file").withColumn("start", F.col("begin") + F.col("place")).select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def round_trip(docs: DataFrame, tokenizer_json: str, end_id: int = 2) -> DataFrame:
    """Writes the ids of docs into the shared folder and reads the files back."""
    path = work_path(docs.sparkSession, "tokens")
    write_token_files(docs, tokenizer_json, path, end_id)
    return read_token_files(docs.sparkSession, path, ids=False)
