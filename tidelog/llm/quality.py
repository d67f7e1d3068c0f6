"""Quality classifier: a sparse ensemble of rules over statistics of the text.

Boosted shallow trees over the statistics give paths; each path is a conjunction of bounds, a rule. A logistic model
with an L1 penalty keeps few of them. The kept rules become one Spark column expression over the statistics.

The model is fitted in the driver on at most FIT_ROWS labelled documents (those of least hash of doc_id; a document
with several labels counts by the greatest, one with several texts by that of the least statistics). All paths of the trees compete for weights. Without labels of
both kinds the score is a constant: the smoothed share of label 1. A null or empty text has statistics of 0 and a score like any other. Repeated rows have equal scores, an
empty table gives an empty result, and further columns, of whatever name, have no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

FIT_ROWS = 12_000
THRESHOLD = 0.3
FOLDS, HELD_OUT_FOLD = 5, 0
TREES, DEPTH, BINS, RATE, LEAST_ROWS, PENALTY = 24, 3, 32, 0.3, 5, 3e-3

STATISTICS = ["chars", "words", "word_length", "upper", "digits", "symbols", "bars", "bangs", "stops", "commas", "high_bytes", "spaces", "lines", "line_length", "distinct_words", "distinct_lines", "top_word", "short_lines", "shouted_words", "entropy"]

_CLASS = np.zeros(256, np.int64)  # by byte: class of the histogram
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~=+<>{}[]\\_/", b"|", b"!", b".?", b",;:", b" \t\r\n\x0b\x0c")):
    _CLASS[list(_chars)] = _i + 1
_CLASS[128:] = 9


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode()
    if not data:
        return [0.0] * len(STATISTICS)
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = np.bincount(_CLASS, counts, 10) / n
    words, lines = data.split(), data.split(b"\n")
    m = max(1, len(words))
    distinct = Counter(words)
    p = counts[counts > 0] / n
    shouted = sum(1 for w in distinct if len(w) > 1 and w.isupper()) / max(1, len(distinct))
    top = max(distinct.values(), default=0) / m
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), sum(map(len, words)) / m, float(share[1]), float(share[2]), float(share[3]), float(share[4]), float(share[5]), float(share[6]), float(share[7]), float(share[9]), float(share[8]),
        float(np.log1p(len(lines))), float(np.log1p(n / len(lines))), len(distinct) / m, len(set(lines)) / len(lines), top, sum(1 for x in lines if len(x) < 20) / len(lines), shouted, float(-(p * np.log2(p)).sum()),
    ]


def with_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns keep, then the statistics as doubles stat_<name>, for each row."""
    others = keep or []
    names = [*others, *[f"stat_{s}" for s in STATISTICS]]
    k = len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, k):
                table = np.array([statistics(t) for t in part.column(k).to_pylist()], np.float64)
                yield pa.RecordBatch.from_arrays([*part.columns[:k], *[pa.array(c) for c in table.T]], names=names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema.fields] + [f"stat_{s} double" for s in STATISTICS])
    return docs.select(*others, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def _grow(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """A tree by gain over binned statistics x: its output and its paths. A path is ((statistic, bound, above), ...)."""
    out, paths = np.zeros(len(g)), []

    def split(rows: np.ndarray, path: tuple, depth: int) -> None:
        if path:
            paths.append(path)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, 0)
        if depth < DEPTH and len(rows) >= 2 * LEAST_ROWS:
            for f in range(x.shape[1]):
                bins = x[rows, f]
                left_g, left_h, left_n = (np.cumsum(np.bincount(bins, w, BINS + 1))[:-1] for w in (g[rows], h[rows], None))
                gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                gain[(left_n < LEAST_ROWS) | (len(rows) - left_n < LEAST_ROWS)] = 0
                gain[len(cuts[f]) :] = 0
                b = int(gain.argmax())
                if gain[b] > best[0]:
                    best = (float(gain[b]), f, b)
        if best[1] < 0:
            out[rows] = -total_g / (total_h + 1)
            return
        _, f, b = best
        above = x[rows, f] > b
        split(rows[~above], (*path, (f, float(cuts[f][b]), False)), depth + 1)
        split(rows[above], (*path, (f, float(cuts[f][b]), True)), depth + 1)

    split(np.arange(len(g)), (), 0)
    return out, paths


def _holds(table: np.ndarray, rule: tuple) -> np.ndarray:
    return np.logical_and.reduce([(table[:, f] > b) if above else (table[:, f] <= b) for f, b, above in rule])


def fit(table: np.ndarray, labels: np.ndarray) -> tuple[float, list[tuple[float, tuple]]]:
    """(intercept, [(weight, rule)])."""
    y = labels.astype(float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    if len(y) < 4 * LEAST_ROWS or len(set(y)) < 2:
        return start, []
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in table.T]
    x = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, table.T)], 1)
    margin, rules = np.full(len(y), start), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step, paths = _grow(x, cuts, p - y, p * (1 - p))
        margin += RATE * step
        rules.update(dict.fromkeys(paths))
    rules = list(rules)
    z = np.stack([_holds(table, r) for r in rules], 1).astype(float)
    usual, spread = z.mean(0), z.std(0) + 1e-3
    z = (z - usual) / spread
    # Proximal gradient with momentum: logistic loss plus an L1 penalty on all but the intercept.
    w, b = np.zeros(z.shape[1]), start
    v, c, t = w.copy(), b, 1.0
    lip = 0.25 * (np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    for _ in range(400):
        r = (1 / (1 + np.exp(-(z @ v + c))) - y) / len(y)
        u = v - z.T @ r / lip
        u = np.sign(u) * np.maximum(np.abs(u) - PENALTY / lip, 0)
        d = c - r.sum() / lip
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = u + (t - 1) / t2 * (u - w), d + (t - 1) / t2 * (d - b)
        w, b, t = u, d, t2
    kept = [(float(a / s), r) for a, s, r in zip(w, spread, rules) if a != 0]
    return float(b - (w / spread * usual).sum()), kept


def compile_score(model: tuple[float, list[tuple[float, tuple]]]) -> Column:
    """The model as a column over the statistics' columns."""
    total = F.lit(model[0])
    for weight, rule in model[1]:
        holds = None
        for f, bound, above in rule:
            c = F.col(f"stat_{STATISTICS[f]}")
            one = c > bound if above else c <= bound
            holds = one if holds is None else holds & one
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def fit_labels(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[float, list[tuple[float, tuple]]]:
    """Fits on the labelled documents outside the held-out fold, on at most that many."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # its size is bounded, so it can be broadcast
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    # One row for each document: at most as many as the sample has.
    each = with_statistics(labelled, keep=["doc_id", "quality"]).groupBy("doc_id", "quality").agg(F.min(F.struct(*[f"stat_{s}" for s in STATISTICS])).alias("x"))
    got = each.select("doc_id", "quality", "x.*").toPandas().sort_values("doc_id")
    return fit(got.iloc[:, 2:].to_numpy(float).reshape(-1, len(STATISTICS)), got["quality"].to_numpy(int))


def score(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """Columns keep and score, for each row of docs."""
    return with_statistics(docs, keep=keep).select(*keep, compile_score(model).alias("score"))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects, with the columns of docs."""
    model = fit_labels(docs, labels)
    # The columns are numbered meanwhile, so none can clash with those of the statistics.
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    scored = with_statistics(numbered, f"c{docs.columns.index('text')}", numbered.columns)
    return scored.where(compile_score(model) >= THRESHOLD).select(*numbered.columns).toDF(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit_labels(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
