"""Maximal periodic runs of words, found in overlapping tiles of each period octave.

A run is a stretch of words with smallest period q and at least ``min_exponent`` periods that no
neighbour extends. Octave k holds the periods from h = 2^k below 2h. A document is exploded into
tiles for each octave: tile t covers T words from t * T on and 6h more, T being 8h and at least
``TILE_WORDS``. Tiles are rows of their own, dealt evenly, and are solved without each other:
at every boundary (a multiple of h inside the tile) one Z-function over what follows and one over
what precedes give, for all periods of the octave at once, how far word c + i equals word c + q + i
on both sides. Extents of a period that meet are one fragment; a fragment whose root is itself a
repetition is dropped. Fragments (first and last matching word) go by document and period, where
those that touch are stitched; a run's ends are those of its stitched fragments.

A run of period q matches in at least 3q >= 3h places, so some tile sees 3h of them with two
boundaries inside, and tiles overlap by more than that: together the fragments of its tiles
cover the run whole.

Most tiles hold no run, and these are not made. Doubling names (the names of windows of 2^k words
are pairs of names of 2^(k-1) words; a window that does not recur is dropped) show at which boundaries a
window of 2h words comes again, and a run of primitive period q in the octave begins with a
boundary whose window comes again first after exactly q words: nearer would give, by Fine and
Wilf, a shorter period. Tiles without such a boundary are left out, which loses no run.

Edge cases: null text has no words; repeated rows and null ids are documents of their own; an empty
table gives an empty result; other columns are not read. One document's words lie in the memory of
one task; its tiles are solved elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, staged

MIN_LENGTH, MIN_EXPONENT = 6, 4
TILE_WORDS = 4096
TILE = pa.struct([("octave", pa.int32()), ("at", pa.int64()), ("ids", pa.binary())])
RUN = "array<struct<start bigint, length bigint, period bigint>>"


def word_ids(words: list[bytes]) -> np.ndarray:
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))


def tile_words(octave: int) -> int:
    return max(TILE_WORDS, 8 << octave)


def active_tiles(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(octave, first word, one past the last word) of the tiles that may see a run, each narrowed
    to what a run can reach from its boundaries with a window that comes again."""
    out = []
    at, name = np.arange(len(ids)), ids  # positions of windows that recur, and their names
    octave = 0
    while len(at):
        h = 1 << octave  # windows of h words now; those of 2h follow
        full = np.full(len(ids) + h, -1, np.int64)
        full[at] = name
        left, right = full[at], full[at + h]
        both = right >= 0
        at, left, right = at[both], left[both], right[both]
        _, name, n = np.unique(left * (len(ids) + 1) + right, return_inverse=True, return_counts=True)
        again = n[name] > 1
        at, name = at[again], name[again]
        if not len(at):
            break
        order = np.argsort(name, kind="stable")  # by name, then position
        p, same = at[order], name[order][1:] == name[order][:-1]
        gap = np.where(same, p[1:] - p[:-1], 0)
        begin = np.sort(p[:-1][(gap >= h) & (gap < 2 * h) & (p[:-1] % h == 0)])
        if len(begin):
            size = tile_words(octave)
            tile, first, count = np.unique(begin // size, return_index=True, return_counts=True)
            spans = {int(t): (int(begin[f]), int(begin[f + n - 1])) for t, f, n in zip(tile, first, count)}
            for t in tile.tolist():  # boundaries in the overlap belong to the tile before as well
                over = begin[(begin >= t * size) & (begin < t * size + 4 * h)] if t else begin[:0]
                if len(over):
                    low, _ = spans.get(t - 1, (int(over[0]), 0))
                    spans[t - 1] = (low, int(over[-1]))
            for t, (low, high) in sorted(spans.items()):
                # a run begins less than h before its first such boundary and ends less than 3h and a period after its last
                out.append((octave, max(t * size, low - 2 * h), min(t * size + size + 6 * h, high + 6 * h, len(ids))))
        octave += 1
    return out


def z_function(s: list[int]) -> list[int]:
    """For each position, how many words from there on equal those from the start."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        m = 0
        if i < right:
            m = z[i - left]
            if m < right - i:
                z[i] = m
                continue
            m = right - i
        while i + m < n and s[m] == s[i + m]:
            m += 1
        z[i] = m
        left, right = i, i + m
    return z


def _divisors(q: int) -> list[int]:
    """q over each of its prime factors, largest first."""
    out, d, rest = [], 2, q
    while rest > 1:
        if d * d > rest:
            d = rest
        if rest % d == 0:
            out.append(q // d)
            while rest % d == 0:
                rest //= d
        d += 1
    return out


def primitive(raw: bytes, start: int, q: int) -> bool:
    """Whether the q words (of 4 bytes) at ``start`` are no repetition of fewer."""
    a, b = 4 * start, 4 * (start + q)
    return not any(raw[a : b - 4 * p] == raw[a + 4 * p : b] for p in _divisors(q))


def solve_tile(octave: int, raw: bytes) -> list[tuple[int, int, int]]:
    """Fragments (period, first and one past the last word that equals the word a period on)."""
    t, h = np.frombuffer(raw, "<i4").tolist(), 1 << octave
    n, out = len(t), []
    open_: dict[int, list[int]] = {}

    def close(q, a, b):
        if b - a >= q and primitive(raw, a, q):
            out.append((q, a, b))

    for c in range(0, n - h, h):
        follow, precede = t[c : c + 3 * h], t[max(0, c - h) : c]
        m = len(follow[:h])
        z = z_function(follow[:h] + [-1] + follow[h:])
        ahead = [min(x, h) for x in z[m + 1 : m + 1 + h]]  # index q - h
        back = [0] * len(ahead)
        if precede:
            whole = t[c : c + 2 * h][::-1]  # word c + q - 1 lies at len(whole) - q
            y = z_function(precede[::-1] + [-1] + whole)
            first = len(precede) + 1 + len(whole)
            for q in range(h, min(len(whole) + 1, h + len(ahead))):
                back[q - h] = y[first - q]
        for i, (r, l) in enumerate(zip(ahead, back)):
            if r == h or l == h:  # a run seen whole reaches from boundary to boundary
                q, a, b = h + i, c - l, c + r
                had = open_.get(q)
                if had and a <= had[1]:
                    had[1] = max(b, had[1])
                else:
                    if had:
                        close(q, *had)
                    open_[q] = [a, b]
    for q, had in open_.items():
        close(q, *had)
    return out


def kept_words(words: list[bytes], runs) -> list[bytes]:
    """The words that no run holds after its first period."""
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [w for w, x in zip(words, step.cumsum().tolist()) if x == 0] if runs else words


def _explode(hook, with_tiles: bool):
    """Rows (id, words, tiles) of the documents that have tiles, or of those that have none."""

    def run(batches):
        for batch in batches:
            at, words, tiles = [], [], []
            for n, (doc, text) in enumerate(zip(batch.column("__id").to_pylist(), batch.column("__text").to_pylist())):
                ws = (text or b"").split()
                if hook is not None:
                    ws = hook(doc, ws)
                ids = word_ids(ws)
                active = active_tiles(ids)
                if bool(active) == with_tiles:
                    at.append(n)
                    words.append(b" ".join(ws))
                    tiles.append([{"octave": k, "at": a, "ids": ids[a:b].astype("<i4").tobytes()} for k, a, b in active])
            yield pa.RecordBatch.from_arrays([batch.column("__id").take(pa.array(at, pa.int64())), pa.array(words, pa.binary()), pa.array(tiles, pa.list_(TILE))], ["__id", "words", "tiles"])

    return run


def _solve(batches):
    for b in batches:
        rows = [
            (row, q, at + first, at + last)
            for row, octave, at, raw in zip(*(b.column(c).to_pylist() for c in ("__row", "octave", "at", "ids")))
            for q, first, last in solve_tile(octave, raw)
        ]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["__row", "period", "a", "b"])


def _stitched(fragments: DataFrame, min_length: int, min_exponent: int) -> DataFrame:
    """(__row, runs) from fragments; a document and period has at most one fragment a tile."""
    own = Window.partitionBy("__row", "period").orderBy("a", "b")
    upto = F.max("b").over(own.rowsBetween(Window.unboundedPreceding, -1))
    new = fragments.withColumn("__new", (upto.isNull() | (F.col("a") > upto)).cast("int")).withColumn("__part", F.sum("__new").over(own))
    runs = new.groupBy("__row", "period", "__part").agg(F.min("a").alias("start"), (F.max("b") + F.col("period") - F.min("a")).alias("length"))
    runs = runs.where((F.col("length") >= min_length) & (F.col("length") >= F.col("period") * min_exponent))
    return runs.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))


def find_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    words: Callable[[object, list[bytes]], list[bytes]] | None = None,
    min_length: int = MIN_LENGTH,
) -> DataFrame:
    """One row per document: id, ``words`` (joined by one space), ``runs`` sorted by start, then
    period, and ``kept``, the words without the repetitions.

    ``words(id, words)`` may give other words for a document, in their own order. Runs have at least
    ``min_length`` words and four periods.
    """
    prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("__id"), F.col(text).cast("binary").alias("__text"))
    schema = f"__id {dict(base.dtypes)['__id']}, words binary, tiles array<struct<octave int, at long, ids binary>>"
    # a document's tiles follow from its words alone, so the two passes share out the documents
    rows = staged(base.mapInArrow(_explode(words, True), schema).withColumn("__row", F.monotonically_increasing_id()), "run-tiles")
    tiles = rows.select("__row", F.inline("tiles"))
    # by hash: neither one document nor one octave stays together
    tiles = tiles.repartition(F.xxhash64("__row", "octave", "at"))
    fragments = tiles.mapInArrow(_solve, "__row long, period long, a long, b long")
    runs = staged(_stitched(fragments, min_length, MIN_EXPONENT), "runs")

    @F.arrow_udf("binary")
    def keep(col: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([b" ".join(kept_words(w.split(b" "), [(x["start"], x["length"], x["period"]) for x in r])) for w, r in zip(col.to_pylist(), found.to_pylist())], pa.binary())

    none = F.array().cast(RUN)
    # always shuffled: the documents with tiles grow with the corpus, and so do their runs
    found = rows.select("__id", "__row", "words").join(runs.hint("merge"), "__row", "left")
    found = found.select("__id", "words", F.coalesce("runs", none).alias("runs")).select("*", keep("words", "runs").alias("kept"))
    clean = base.mapInArrow(_explode(words, False), schema).select("__id", "words", none.alias("runs"), F.col("words").alias("kept"))
    return found.unionByName(clean).withColumnRenamed("__id", id_col)
