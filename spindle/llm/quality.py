"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Statistics are counts and ratios of the whole text (words, repeats, symbols, lines); labels,
language, source and id never enter them. Training draws a bounded sample of labelled rows (at
most ``max_rows`` in hash order of the id, so the same rows on every run; where ids repeat, each
text and label of an id counts once and the cut is in hash order of id and text), bins each statistic at
its quantiles and boosts depth-limited trees on the logistic loss; the histograms of all
statistics at a level are one ``bincount``. The trees become flat arrays (feature, bin, leaf
values) that numpy walks level by level for a whole batch. Scoring is one pass without a shuffle.

Edge cases: null text is empty and is scored like any text; a label or id that is null does not
train; rows and labels that repeat count once; with no labelled rows, or
labels all alike, the score is the smoothed share of label 1 (0.5 without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, prepare, row_key

MAX_ROWS = 20_000
BINS = 64
FEATURES = [
    "log_words", "log_chars", "mean_word", "distinct_share", "top_share", "repeat_next", "symbol_share",
    "bar_share", "digit_share", "upper_share", "stop_share", "comma_share", "lines_per_word",
    "distinct_lines", "junk_ends", "long_words", "entropy", "nonascii", "single_char", "top3_share",
]
DIGITS, UPPER = frozenset(b"0123456789"), frozenset(range(65, 91))
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#$%&*+<=>@[\\]^_`{|}~/")] = True
IS_DIGIT, IS_UPPER = np.zeros(256, bool), np.zeros(256, bool)
IS_DIGIT[list(DIGITS)] = True
IS_UPPER[list(UPPER)] = True


def statistics(text: str | None) -> np.ndarray:
    """The features of one whole text."""
    raw = (text or "").encode()
    words = raw.split()
    out = np.zeros(len(FEATURES), np.float64)
    if not words:
        return out
    n, size = len(words), len(raw)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    freq = np.sort(np.fromiter(counts.values(), np.float64, len(counts)))[::-1]
    lines = raw.split(b"\n")
    lens = np.fromiter(map(len, words), np.float64, n)
    last = np.bincount(np.fromiter((w[-1] for w in words), np.int64, n), minlength=256)
    p = freq / n
    out[:] = (
        np.log1p(n), np.log1p(size), lens.mean(), len(counts) / n, p[0], sum(map(bytes.__eq__, words[1:], words)) / n,
        hist[SYMBOLS].sum() / size, hist[124] / n, hist[IS_DIGIT].sum() / size, hist[IS_UPPER].sum() / n, hist[46] / n,
        hist[44] / n, len(lines) / n, len(set(lines)) / len(lines), last[SYMBOLS].sum() / n, (lens > 20).mean(),
        float(-(p * np.log(p)).sum()) / np.log(n + 1), hist[128:].sum() / size, (lens == 1).mean(), p[:3].sum(),
    )
    return out


class Trees:
    """Boosted trees as arrays; leaf i of a tree of depth d follows its d answers as bits."""

    def __init__(self, base: float, edges: list[np.ndarray], depth: int):
        self.base, self.edges, self.depth = base, edges, depth
        self.feature: list[np.ndarray] = []
        self.bin: list[np.ndarray] = []
        self.value: list[np.ndarray] = []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, b: np.ndarray) -> np.ndarray:
        out, row = np.full(len(b), self.base), np.arange(len(b))
        for feature, cut, value in zip(self.feature, self.bin, self.value, strict=True):
            node = np.zeros(len(b), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[row, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(self.binned(x)))) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 5.0) -> Trees:
    share = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(len(FEATURES))] if len(y) else [np.zeros(0)] * len(FEATURES)
    model = Trees(float(np.log(share / (1 - share))), edges, depth)
    if len(np.unique(y)) < 2:
        return model
    b = model.binned(x)
    m, k = b.shape
    flat = b + np.arange(k) * BINS
    margin, inner = np.full(m, model.base), 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)  # default: all left
        node = np.zeros(m, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (k * BINS) + flat).ravel()
            g = np.bincount(at, np.repeat(grad, k), width * k * BINS).reshape(width, k, BINS).cumsum(2)
            h = np.bincount(at, np.repeat(hess, k), width * k * BINS).reshape(width, k, BINS).cumsum(2)
            G, H = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (G - g) ** 2 / (H - h + l2) - G**2 / (H + l2)
            gain[(h < 1) | (H - h < 1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            won = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            feature[first : first + width] = np.where(won, best // BINS, 0)
            cut[first : first + width] = np.where(won, best % BINS, BINS)
            node = 2 * node + 1 + (b[np.arange(m), feature[node]] > cut[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, hess, 2**depth) + l2)
        model.feature.append(feature)
        model.bin.append(cut)
        model.value.append(value)
        margin += value[leaf]
    return model


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))


def _stat_rows(batches):
    for b in batches:
        x = [statistics(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array([r.tolist() for r in x], pa.list_(pa.float64())), b.column("y"), b.column("key")], ["x", "y", "key"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> Trees:
    """Fit on at most ``max_rows`` labelled documents outside the held-out third."""
    usable = F.col(id_col).isNotNull() & (remainder(id_col) != 1)
    marked = labels.where(usable & F.col(label).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("y"))
    drawn = marked.distinct().orderBy(F.xxhash64("__id"), "__id", "y").limit(max_rows)  # bounded, so safe to broadcast
    rows = docs.select(*row_key(id_col, text), F.col(text).alias("text")).join(F.broadcast(drawn), "__id")
    rows = rows.select("text", "y", F.struct("__id", "__rk").alias("key"))
    stats = rows.mapInArrow(_stat_rows, f"x array<double>, y int, key {dict(rows.dtypes)['key']}")
    once = stats.groupBy("key", "y").agg(F.first("x").alias("x"))  # equal in id and text: equal in x
    got = once.orderBy(F.xxhash64("key"), "key", "y").limit(max_rows).select("x", "y").collect()
    got.sort(key=lambda r: (r.x, r.y))
    x = np.array([r.x for r in got], np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.y for r in got], np.float64))


def with_score(docs: DataFrame, model: Trees, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the model's score of each whole text in ``out`` (a column of that name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    @F.arrow_udf("double")
    def score(col: pa.Array) -> pa.Array:
        give_back()
        x = np.array([statistics(t.as_py()) for t in col], np.float64).reshape(-1, len(FEATURES))
        return pa.array(shared.value.score(x))

    return docs.withColumn(out, score(F.col(text)))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, score and predicted for every document."""
    prepare(docs.sparkSession)
    model = train(docs, labels, id_col=id_col, text=text)
    out = with_score(docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")), model, "__text")
    return out.select(
        F.col("__id").alias(id_col),
        F.coalesce(remainder("__id") == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
