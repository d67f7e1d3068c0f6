"""Byte-level BPE encoding and decoding in linear time.

An Aho-Corasick automaton over the whole vocabulary (bytes mapped to Latin-1 characters) finds the longest
token at every byte. The encoder walks forward with the longest token that is compatible with the token
before it and steps back to shorter ones or to the token before where none is. Two adjacent tokens are
compatible if merging their bytes by rank would end in just these two; that test undoes merges and is
memoised. A sequence whose neighbours are all compatible is the one that merging by rank gives, so
the result is exact, and each byte is left by a failed step once at most.

Defined results: a null text counts as empty and gives no ids; lone input order and repeated rows are kept.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Pieces kept in a worker's memory; the memo is emptied when it is full.
MEMO_PIECES = 300_000
MEMO_PIECE_CHARS = 64


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a rank file (base64 token, space, rank in each line)."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


class Coder:
    def __init__(self, tokens: list[bytes], pattern: str):
        import ahocorasick
        import regex

        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.lengths = [len(t) for t in tokens]
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int] | None] = []
        self.shorter: list[int] = []
        self.memo_pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}
        for i, t in enumerate(tokens):
            self.halves.append(self._split(i, t))
            self.shorter.append(next((p for k in range(len(t) - 1, 0, -1) if (p := self.rank.get(t[:k])) is not None), -1))
        self.memo_pairs.clear()

    def _split(self, i: int, t: bytes) -> tuple[int, int] | None:
        """The two tokens that the last merge of token i joined; None for single bytes."""
        for k in range(1, len(t)):
            left, right = self.rank.get(t[:k]), self.rank.get(t[k:])
            if left is not None and right is not None and left < i and right < i and self._compatible(left, right):
                self.merged[left, right] = i
                return left, right
        return None

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps the border between two neighbouring tokens."""
        bound = len(self.tokens) + 1
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < bound:
                return False
            # Undo the later of the two merges: what joined across the border before it would have come first.
            if left > right:
                halves, bound = self.halves[left], left
                if halves is None:
                    halves, bound = self.halves[right], right + 1
                    if halves is None:
                        return True
                    right = halves[0]
                else:
                    left = halves[1]
            else:
                halves, bound = self.halves[right], right + 1
                if halves is None:
                    halves, bound = self.halves[left], left
                    if halves is None:
                        return True
                    left = halves[1]
                else:
                    right = halves[0]

    def compatible(self, left: int, right: int) -> bool:
        known = self.memo_pairs.get((left, right))
        if known is None:
            if len(self.memo_pairs) > 2_000_000:
                self.memo_pairs.clear()
            known = self.memo_pairs[left, right] = self._compatible(left, right)
        return known

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece of the pattern."""
        if not data:
            return []
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        n, lengths, shorter = len(data), self.lengths, self.shorter
        longest = [-1] * n
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - lengths[token]] = token  # ends ascend, so the last is the longest
        dead = bytearray(n + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0 and (dead[at + lengths[token]] or (ids and not self.compatible(ids[-1], token))):
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at += lengths[token]
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                if not ids:
                    raise ValueError("the vocabulary lacks a single byte of the text")
                token = ids.pop()
                at -= lengths[token]
                token = shorter[token]
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        memo, out = self.memo, []
        for part in self.find(text):
            ids = memo.get(part)
            if ids is None:
                ids = b"".join([i.to_bytes(4, "little") for i in self.piece(part.encode())])
                if len(part) <= MEMO_PIECE_CHARS:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[part] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I").tolist())) if ids else b""


_coders: dict[str, Coder] = {}


def _coder(key: str, vocabulary, pattern: str) -> Coder:
    """One coder for each worker process and vocabulary."""
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(vocabulary.value, pattern)
    return _coders[key]


def encode_decode(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids, decoded) for each row of docs: the ids as little-endian unsigned 32-bit integers and
    the bytes that decoding these ids gives. The vocabulary has a fixed size and is broadcast by the driver."""
    tokens = load_ranks(vocabulary_path)
    key = hashlib.sha256(repr((tokens, pattern)).encode()).hexdigest()
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(key, vocabulary, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                ids = [coder.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([coder.decode(x) for x in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    coded = encode_decode(docs, vocabulary_path, pattern)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
