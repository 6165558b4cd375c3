"""Repeated passages by level-wise doubling of word windows.

A window of w words can only repeat if its parts do. Levels have lengths of about w/4, w/2 and
w: at each, every window still in question names one part of the level's length, the one with
the smallest hash (a function of the window's words alone, so that equal windows name equal
parts), and only named parts are counted over the corpus, which at the first level is about one
position in fourteen. Windows whose part stands only once are out; runs of the others are cut
out and go on to twice the length, until at length w the windows themselves are counted, by 128
bits of hash. Counting is one
shuffle by hash in which equal parts come to stand side by side and are told in a stream, so no
group is ever gathered; parts that are equal within a block of texts are told there, and only one
of them is sent to their hash, so common passages don't pile up in a task.

Edge cases: null text has no words; documents shorter than the window keep all; rows repeated in
id and text repeat all their windows; rows that share an id only are documents of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, row_key, staged, text_or_empty

WINDOW = 35


def levels(window: int) -> list[int]:
    out = [window]
    while out[0] > 9:
        out.insert(0, -(-out[0] // 2))
    return out


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` words from the words' hashes, by doubling."""
    size = 1
    while 2 * size <= length:
        h = _mix(h[:-size], h[size:])
        size *= 2
    return _mix(h[: len(h) - (length - size)], h[length - size :]) if size < length else h


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


class Block:
    """The words of a few texts in one row, with the part that each window names."""

    def __init__(self, texts: list[bytes], length: int, window: int):
        self.words: list[bytes] = []
        lens = []
        for t in texts:
            w = t.split()
            self.words += w
            lens.append(len(w))
        n, lens = len(self.words), np.array(lens, np.int64)
        self.starts = np.cumsum(lens) - lens
        self.text = np.repeat(np.arange(len(texts)), lens)
        self.parts, self.valid, self.named = np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
        if n < window:
            return
        self.parts = window_hashes(word_hashes(self.words), length)
        self.valid = self.text[: n - window + 1] == self.text[window - 1 :]
        slide = window - length + 1
        if n <= POSITIONS:  # hash and position in one number; the leftmost wins among equals
            low = (self.parts & ~np.uint64(POSITIONS - 1)) | np.arange(len(self.parts), dtype=np.uint64)
            size = 1
            while 2 * size <= slide:
                low = np.minimum(low[:-size], low[size:])
                size *= 2
            low = np.minimum(low[: len(low) - (slide - size)], low[slide - size :]) if size < slide else low
            self.named = (low & np.uint64(POSITIONS - 1)).astype(np.int64)
        else:
            high = self.parts >> np.uint64(POSITIONS.bit_length() - 1)
            self.named = sliding_window_view(high, slide).argmin(axis=1) + np.arange(n - window + 1)


POSITIONS = 1 << 24
BLOCK_BYTES = 8 << 20


def _blocks(batch: pa.RecordBatch, length: int, window: int):
    """(first row, block) of consecutive rows of a batch, of bounded size."""
    texts, first, size = [], 0, 0
    for n, t in enumerate(batch.column("text")):
        t = t.as_py()
        if texts and size + len(t) > BLOCK_BYTES:
            yield first, Block(texts, length, window)
            texts, first, size = [], n, 0
        texts.append(t)
        size += len(t)
    if texts:
        yield first, Block(texts, length, window)


def _emitter(key: list[str], length: int, window: int):
    """Rows (key, pos, h1, h2, n) of the named parts. Equal parts of one block know of each other
    at once: one of them asks for all (n = 2), and the others (n = 3) are spread at random."""

    def emit(batches):
        for b in batches:
            for first, block in _blocks(b, length, window):
                at = np.unique(block.named[block.valid])
                if not len(at):
                    continue
                h1 = block.parts[at]
                h2 = window_hashes(word_hashes(block.words, 1), length)[at] if length == window else np.zeros(len(at), np.uint64)
                order = np.lexsort((h2, h1))
                same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
                n = np.ones(len(at), np.int32)
                n[order] += np.append(same, False).astype(np.int32)
                n[order[1:][same]] = 3
                told = n == 3
                h1[told], h2[told] = _mix(h1[told], at[told].astype(np.uint64)), _mix(h1[told], ~at[told].astype(np.uint64))
                text = block.text[at]
                take = pa.array(text + first)
                cols = [b.column(c).take(take) for c in key]
                cols += [pa.array((at - block.starts[text]).astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (h1, h2)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(cols, [*key, "pos", "h1", "h2", "n"])

    return emit


def _repeats(key: list[str]):
    """Of rows in hash order, those that stand beside an equal one or know that there is one."""

    def flag(batches):
        held = None  # the last row, which waits for its successor, and whether it is known
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            h1, h2, n = (t.column(c).to_numpy() for c in ("h1", "h2", "n"))
            same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            known = (n > 1) | np.append(same, False) | np.insert(same, 0, False)
            out = t.slice(0, len(n) - 1).filter(pa.array(known[:-1]))
            yield from out.select([*key, "pos"]).combine_chunks().to_batches()
            held = t.slice(len(n) - 1)
            held = held.set_column(held.column_names.index("n"), "n", pa.array([3 if known[-1] else int(n[-1])], pa.int32()))
        if held is not None and held.column("n")[0].as_py() > 1:
            yield from held.select([*key, "pos"]).combine_chunks().to_batches()

    return flag


def _narrower(key: list[str], length: int, window: int):
    """Cut out the runs of windows whose named part is in ``hits``."""

    def narrow(batches):
        for b in batches:
            for first, block in _blocks(b, length, window):
                rows = [b.column("hits")[first + k].as_py() for k in range(len(block.starts))]
                mark = np.zeros(len(block.words), bool)
                mark[np.concatenate([s + np.array(h, np.int64) for s, h in zip(block.starts, rows)])] = True
                in_ = np.concatenate([[False], block.valid & mark[block.named], [False]]).astype(np.int8)
                edge = np.flatnonzero(np.diff(in_))
                begin, end = edge[::2], edge[1::2]
                text = block.text[begin]
                take = pa.array(text + first)
                off = b.column("off").take(take).to_numpy() + begin - block.starts[text]
                words = [b" ".join(block.words[x : y + window - 1]) for x, y in zip(begin.tolist(), end.tolist())]
                cols = [b.column("__id").take(take), b.column("__rk").take(take), pa.array(off, pa.int64()), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["__id", "__rk", "off", "text"])

    return narrow


def _hits(units: DataFrame, key: list[str], length: int, window: int) -> DataFrame:
    """(key, hits): the positions of each unit's named parts that stand more than once."""
    types = ", ".join(f"{c} long" for c in key)
    parts = units.select(*key, "text").mapInArrow(_emitter(key, length, window), f"{types}, pos int, h1 long, h2 long, n int")
    dealt = parts.repartition("h1", "h2").sortWithinPartitions("h1", "h2")
    again = dealt.mapInArrow(_repeats(key), f"{types}, pos int")
    return again.groupBy(*key).agg(F.collect_set("pos").alias("hits")).select(*[F.col(c).alias(f"{c}_") for c in key], "hits")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(``__id``, ``__rk``, ``starts``): the first words of a row's windows that start elsewhere too."""
    units = docs.select(*row_key(id_col, text), F.lit(0).cast("long").alias("off"), text_or_empty(text).cast("binary").alias("text"))
    key, before = ["__id", "__rk"], []
    for length in levels(window):
        hits = staged(_hits(units, key, length, window), f"hits-{length}")
        same = units[key[0]].eqNullSafe(hits[f"{key[0]}_"])
        for c in key[1:]:
            same = same & (units[c] == hits[f"{c}_"])
        if length == window:
            starts = F.transform("hits", lambda p: p + F.col("off").cast("int"))
            found = units.select(*dict.fromkeys([*key, "__id", "__rk", "off"])).join(hits, same).select("__id", "__rk", starts.alias("s"))
            if not before:  # a single level: the units are the rows themselves, repeats with them
                found = found.distinct()
            out = staged(found.groupBy("__id", "__rk").agg(F.flatten(F.collect_list("s")).alias("starts")), "repeated")
            discard(hits, *before)
            return out
        found = units.join(hits, same).select("__id", "__rk", "off", "text", "hits")
        after = found.mapInArrow(_narrower(key, length, window), "__id long, __rk long, off long, text binary")
        after = staged(after.withColumn("unit", F.monotonically_increasing_id()), f"runs-{length}")
        discard(hits, *before)
        units, key, before = after, ["unit"], [after]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_removed and the kept words, joined by one space, of every row."""
    prepare(docs.sparkSession)
    found = repeated_windows(docs, id_col, text, window)
    rows = docs.select(*row_key(id_col, text), text_or_empty(text).cast("binary").alias("text"))
    right = found.select(F.col("__id").alias("__i"), F.col("__rk").alias("__k"), "starts")
    both = rows.join(right, rows["__id"].eqNullSafe(right["__i"]) & (rows["__rk"] == right["__k"]), "left")

    def cut(batches):
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for t, starts in zip(b.column("text"), b.column("starts")):
                words = t.as_py().split()
                n_words.append(len(words))
                if starts.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(starts.as_py())
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    stay = np.cumsum(edge)[:-1] == 0
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column("__id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                [id_col, "n_words", "n_removed", "kept"],
            )

    return both.select("__id", "text", "starts").mapInArrow(cut, f"`{id_col}` long, n_words long, n_removed long, kept string")
