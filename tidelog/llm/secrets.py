"""Secret scans with a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived that every text with a match
satisfies. Each block of texts gets an inverted index, made in one pass over its bytes, of the trigrams that the queries mention; postings
are intersected and united as the queries say, and the surviving texts are verified with the expression itself.
Rules without a mandatory trigram scan every text. The index holds lower-case letters (A-Z only) of UTF-8 bytes, so that
one index serves rules with and without regard to case; it only ever lets more candidates through.

Defined results: a null or empty text has no spans; repeated rows give repeated results; an empty table gives an empty result; spans count code points; further
columns, of whatever name, stay as they are. A web token (jwt) starts where no character of its alphabet stands before it, so that long runs are read once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: (kind, expression, least length of the whole match, least length of group 2), in the order in which spans of one start are listed.
BASE_RULES = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0, 6),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]+", 24, 0),
]
ADDED_RULES = [
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 0),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
]
RULES = BASE_RULES + ADDED_RULES

#: A query is None (every text), a trigram, or ("and" | "or", parts).
MAX_STRINGS = 64


def _fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _all(parts: list) -> object:
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return None if None in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> object:
    """Trigrams are of UTF-8 bytes, written as Latin-1."""
    strings = {s.encode().decode("latin-1") for s in strings}
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _sequence(nodes) -> tuple[set[str] | None, object]:
    """(the strings that the nodes match, if they are few, else None; the query)."""
    run, found = {""}, []
    broken = False
    for kind, arg in nodes:
        exact, query = _node(kind, arg)
        if exact is not None and len(run) * len(exact) <= MAX_STRINGS:
            run = {a + b for a in run for b in exact}
            continue
        broken = True
        found.append(_of_strings(run))
        if exact is None:
            found.append(query)
            run = {""}
        else:
            run = exact
    return (None if broken else run), _all([*found, _of_strings(run)])


def _node(kind, arg) -> tuple[set[str] | None, object]:
    if kind is op.LITERAL:
        return {_fold(chr(arg))}, None
    if kind is op.IN:
        chars: set[str] = set()
        for what, value in arg:
            if what is op.LITERAL:
                chars.add(_fold(chr(value)))
            elif what is op.RANGE and value[1] - value[0] < MAX_STRINGS:
                chars |= {_fold(chr(c)) for c in range(value[0], value[1] + 1)}
            else:
                return None, None
        return (chars if len(chars) <= 8 else None), None
    if kind is op.SUBPATTERN:
        return _sequence(arg[-1])
    if kind is op.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        strings = set().union(*(e for e, _ in parts)) if all(e is not None for e, _ in parts) else None
        return (strings if strings is not None and len(strings) <= MAX_STRINGS else None), _any([q for _, q in parts])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, body = arg
        exact, query = _sequence(body)
        if exact is not None and most == 1 and least == 0:
            return exact | {""}, None
        if exact is not None and least == most and len(exact) ** least <= MAX_STRINGS:
            run = {""}
            for _ in range(least):
                run = {a + b for a in run for b in exact}
            return run, None
        return None, (query if least else None)
    if kind is op.AT:
        return {""}, None
    return None, None


def trigram_query(pattern: str) -> object:
    return _sequence(_parser.parse(pattern))[1]


def trigrams(query: object) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(p) for p in query[1]))


def _rows(query: object, postings: dict[str, set[int]], everything: set[int]) -> set[int]:
    if query is None:
        return everything
    if isinstance(query, str):
        return postings[query]
    parts = [_rows(p, postings, everything) for p in query[1]]
    return set.intersection(*parts) if query[0] == "and" else set.union(*parts)


class Scanner:
    def __init__(self, rules=RULES):
        self.rules = [(kind, re.compile(pattern, re.ASCII), whole, group, trigram_query(pattern)) for kind, pattern, whole, group in rules]
        # A run of one class with a least length: shorter runs fail whatever follows, so the engine may skip them.
        self.rules = [(k, re.compile(p.pattern[:-1] + "{%d,}" % w) if re.fullmatch(r"\[[^\]]+\]\+", p.pattern) and w else p, w, g, q) for k, p, w, g, q in self.rules]
        self.mentioned = sorted(set().union(*(trigrams(q) for *_, q in self.rules)))
        self.number = np.zeros(1 << 24, np.uint8 if len(self.mentioned) < 255 else np.uint16)  # by trigram, from 1
        for i, g in enumerate(self.mentioned):
            self.number[int.from_bytes(g.encode("latin-1"), "big")] = i + 1

    def postings(self, texts: list[bytes]) -> dict[str, set[int]]:
        """For each mentioned trigram the texts that hold it (and now and then one that ends where it begins)."""
        data = np.frombuffer(b"".join(texts) + bytes(2), np.uint8).astype(np.uint32)
        number = self.number[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
        at = np.nonzero(number)[0]
        ends = np.cumsum([len(t) for t in texts])
        found = np.unique(number[at].astype(np.int64) * max(1, len(texts)) + np.searchsorted(ends, at, "right"))
        out: dict[str, set[int]] = {g: set() for g in self.mentioned}
        for key in found.tolist():
            out[self.mentioned[key // len(texts) - 1]].add(key % len(texts))
        return out

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text the spans (start, rule number, end), by start and rule."""
        everything = {i for i, t in enumerate(texts) if t}
        postings = self.postings([t.encode().lower() if t else b"" for t in texts])
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, (_, pattern, whole, group, query) in enumerate(self.rules):
            for i in _rows(query, postings, everything) & everything:
                for m in pattern.finditer(texts[i]):
                    if m.end() - m.start() >= whole and (not group or len(m[2]) >= group):
                        out[i].append((m.start(), number, m.end()))
        for spans in out:
            spans.sort()
        return out


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows (doc_id, spans, *keep), one for each row of docs; spans as array of (kind, start, end)."""
    kinds = [r[0] for r in rules]
    others = keep or []
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for part in slices(batch, 1):
                found = scanner.scan(part.column(1).to_pylist())
                spans = pa.array([[{"kind": kinds[k], "start": s, "end": e} for s, k, e in x] for x in found], kind_of)
                yield pa.RecordBatch.from_arrays([part.column(0), spans, *part.columns[2:]], names=["doc_id", "spans", *others])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"), *[F.col(c) for c in others])
    schema = f"doc_id long, spans {SPANS}" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema.fields)
    return source.mapInArrow(run, schema)


def listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """The counts and digests of all spans of each document."""
    found = scan(docs)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin([r[0] for r in BASE_RULES]))
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(listing(base).cast("binary"), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"))


def redact(text: str, spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    """Replaces the union of overlapping spans by [kind] of its first span."""
    out, at, end, kind = [], 0, -1, ""
    for s, k, e in spans:
        if s < end:
            end = max(end, e)
            continue
        if end >= 0:
            out.append(f"[{kind}]")
            at = end
        out.append(text[at:s])
        at, end, kind = s, e, kinds[k]
    if end >= 0:
        out.append(f"[{kind}]")
        at = end
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, rules=RULES, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """docs with every span replaced by its kind in brackets; rows without a span stay as they are. Where a text changes,
    count_col (if docs has it) becomes its length in code points."""
    kinds = [r[0] for r in rules]
    names, where = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for part in slices(batch, where):
                texts = part.column(where).to_pylist()
                spans = scanner.scan(texts)
                if not any(spans):
                    yield part
                    continue
                fresh = [redact(t, x, kinds) if x else t for t, x in zip(texts, spans)]
                columns = list(part.columns)
                columns[where] = pa.array(fresh, columns[where].type)
                if count_col in names:
                    at = names.index(count_col)
                    counts = [len(f) if x else c for f, x, c in zip(fresh, spans, columns[at].to_pylist())]
                    columns[at] = pa.array(counts, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
