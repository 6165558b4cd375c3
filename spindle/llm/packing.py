"""Tokenize, cut and pack documents into sequences of bounded length.

Packing needs only lengths. Pieces are dealt at random to shards of ``SHARD_ITEMS``; each shard
starts from best-fit decreasing and then runs a swap-based local search: between underfull bins
it moves a document or exchanges one for one, two for one or one for two, always into the fuller
bin (so the sum of squared fills rises), until the emptiest bins are empty or nothing helps. A
shard closes its full bins and gives its underfull ones back; those of all shards are dealt anew
as whole bins in the next round, which packs their pieces afresh or, if that takes no fewer bins,
goes on from the bins as they came. Rounds end when a round has one shard, frees no bin or leaves none underfull.
No task sees more than a shard.

Edge cases: null text is empty (its piece is the end id alone); repeated rows are packed as often
as they stand; only documents over the capacity are cut; an empty table gives an empty result.
The local search takes its sources in blocks of ``SEARCH_BINS``, emptiest bins first, and goes on
to the next block once one is stuck; every piece is placed whatever it finds.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merger, PairTable, trim
from .common import give_back, prepare, staged

CAPACITY = 4096
SHARD_ITEMS = 8192
SEARCH_BINS = 64
OPEN_SLACK = 256  # a bin with more than 1/256 of the capacity free is dealt anew
CACHE_WORDS = 400_000
BLOCK_BYTES = 1 << 19

SPACE = re.compile(rb"[\x20\x09-\x0D]")  # where bytes.split() parts words
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(b" \t\n\v\f\r")] = True
# bytes of small Latin letters in valid UTF-8 (the second bytes follow 0xC3 alone, all other
# leading bytes being absent), and the marks that may end a word
LETTERS = bytes([*range(ord("a"), ord("z") + 1), 0xC3, *range(0x9F, 0xB7), *range(0xB8, 0xC0)])
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'")
IS_LETTER, IS_MARK = np.zeros(256, bool), np.zeros(256, bool)
IS_LETTER[list(LETTERS)] = IS_MARK[list(MARKS)] = True
PIECE = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])


class RowMerger(Merger):
    """The same merges for many short pieces, given as places in a buffer: the lowest rank of a row
    of up to ``ROW_BYTES`` is found by one pass over the row, which costs less than a tree's upkeep;
    longer pieces take the trees."""

    ROW_BYTES = 32

    def merge_at(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces, where each piece's ids begin, how many they are)."""
        flat, first, size, n = [], np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), 0
        power = np.maximum(1, np.ceil(np.log2(np.maximum(lens, 1)))).astype(np.int64)
        for k in np.unique(power):
            members, width = np.flatnonzero(power == k), 1 << int(k)
            step = max(1, (1 << 18) // width)
            for a in range(0, len(members), step):
                part = members[a : a + step]
                if width <= self.ROW_BYTES:
                    ids, count = self._rows(buf, starts[part], lens[part], width)
                else:
                    got = self.merge([buf[i : i + m].tobytes() for i, m in zip(starts[part].tolist(), lens[part].tolist())])
                    ids, count = np.frombuffer(b"".join(got), "<u4"), np.array([len(x) // 4 for x in got])
                flat.append(ids)
                first[part], size[part] = n + np.cumsum(count) - count, count
                n += len(ids)
        return np.concatenate([np.zeros(0, np.uint32), *flat]).astype(np.uint32), first, size

    def _rows(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        m, none, place = len(starts), np.int32(2**31 - 1), np.arange(size)
        inside = place < lens[:, None]
        code = np.where(inside, self.first[buf[np.minimum(starts[:, None] + place, len(buf) - 1)]], -1).astype(np.int32)
        code[np.arange(m), lens - 1] = self.last[buf[starts + lens - 1]]
        rank = np.full((m, size), none, np.int32)
        r, c = np.nonzero(inside[:, 1:])
        got = self.pairs.get(code[r, c].astype(np.int64), code[r, c + 1].astype(np.int64))
        rank[r, c] = np.minimum(got, none)
        nxt = np.tile(np.arange(1, size + 1), (m, 1))
        nxt[nxt >= lens[:, None]] = size
        prv = np.tile(np.arange(-1, size - 1), (m, 1))
        flat, code_, nxt_, prv_ = rank.reshape(-1), code.reshape(-1), nxt.reshape(-1), prv.reshape(-1)
        act = np.flatnonzero(rank.min(1) < none)
        while len(act):
            at = act * size
            i = at + rank[act].argmin(1)  # the leftmost of the lowest
            made = flat[i].astype(np.int64)
            j = at + nxt_[i]
            k = nxt_[j]
            code_[i], code_[j] = made, -1
            flat[i] = flat[j] = none
            nxt_[i] = k
            has = np.flatnonzero(k < size)
            after = at[has] + k[has]
            prv_[after] = i[has] - at[has]
            flat[i[has]] = np.minimum(self.pairs.get(made[has], code_[after].astype(np.int64)), none)
            before = prv_[i]
            has = np.flatnonzero(before >= 0)
            left = at[has] + before[has]
            flat[left] = np.minimum(self.pairs.get(code_[left].astype(np.int64), made[has]), none)
            act = act[rank[act].min(1) < none]
        keep = code >= 0
        return code[keep].astype(np.uint32), keep.sum(axis=1)


def spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places of all spans, one after another."""
    ends = np.cumsum(lens)
    return np.repeat(starts - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)


class PartCache:
    """Ids of parts of words as sorted arrays: by hash, with the part's bytes to make sure."""

    def __init__(self):
        self.key, self.text, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        self.at = self.len = self.first = self.size = np.zeros(0, np.int64)

    def find(self, h: np.ndarray, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the arrays, whether the part is there) of distinct parts by rising hash."""
        place = np.searchsorted(self.key, h)
        if not len(self.key):
            return place, np.zeros(len(h), bool)
        near = np.minimum(place, len(self.key) - 1)
        hit = np.flatnonzero((self.key[near] == h) & (self.len[near] == lens))
        differ = self.text[spans(self.at[near[hit]], lens[hit])] != buf[spans(starts[hit], lens[hit])]
        wrong = np.add.reduceat(differ, np.cumsum(lens[hit]) - lens[hit]) > 0 if len(hit) else np.zeros(0, bool)
        there = np.zeros(len(h), bool)
        there[hit[~wrong]] = True
        return place, there

    def add(self, place, h, buf, starts, lens, ids, first, size) -> None:
        """``ids``: those of the cache and behind them the new ones, to which ``first`` points."""
        taken = self.key[np.minimum(place, len(self.key) - 1)] == h if len(self.key) else np.zeros(len(h), bool)  # another part of the same hash: not kept
        place, h, starts, lens, first, size = (x[~taken] for x in (place, h, starts, lens, first, size))
        values = {"key": h, "at": len(self.text) + np.cumsum(lens) - lens, "len": lens, "first": first, "size": size}
        for name, x in values.items():
            setattr(self, name, np.insert(getattr(self, name), place, x))
        self.text, self.ids = np.concatenate([self.text, buf[spans(starts, lens)]]), ids

    def trim(self, most: int) -> None:
        """Forget the newer half of a full cache; frequent words are met early, so they stay."""
        if len(self.key) > most:
            old = self.at < np.partition(self.at, most // 2)[most // 2]
            for name in ("key", "at", "len", "first", "size"):
                setattr(self, name, getattr(self, name)[old])
            self.text, self.ids = self.text[: int((self.at + self.len).max())].copy(), self.ids[: int((self.first + self.size).max())].copy()


class WordTokenizer:
    """ids of a library tokenizer whose tokens never cross white space, with a word cache.

    Words of small Latin letters that end in any ASCII marks but an apostrophe, for which
    normalising does nothing and splitting parts letters and marks, are merged in numpy blocks
    with the library's own vocabulary and merges; every other word goes to the library. The
    tokenizer's special literals (``<|endoftext|>``), matched by their case before anything is
    normalised, give their one id wherever they stand, as in the library's plain call.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True  # for lower-case words: the literals are cut out before, by their case
        self.cache: dict[bytes, bytes] = {}  # of single texts
        self.parts = PartCache()  # of blocks
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or not t["special"] for t in added):
            raise ValueError("added tokens must be special literals that are matched as they stand")
        # a key with a space is no word
        self.literals = {b" " + t["content"].encode(): np.array([t["id"]], "<u4").tobytes() for t in added}
        longest = sorted((k[1:] for k in self.literals), key=len, reverse=True)
        self.literal = re.compile(b"(" + b"|".join(map(re.escape, longest)) + b")") if longest else None
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        ids = [r for _, _, r in pairs]
        if ids != sorted(ids):
            raise ValueError("merged ids must rise with the order of the merges")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # the byte alphabet: itself if it can be shown
        hidden = [b for b in range(256) if b not in shown]
        char = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
        first, last = (np.array([vocab[char[b] + e] for b in range(256)], np.int64) for e in ("", end))
        self.merger = RowMerger(PairTable(pairs, len(vocab) + 2), first, last)

    def _fill(self, words: set[bytes]) -> None:
        """Ids of words that the cache lacks."""
        cache, letters, marks = self.cache, LETTERS, MARKS
        plain, other, new = [], [], set()
        for w in words:
            a = w.rstrip(marks)
            if not a or a.translate(None, letters):
                other.append(w)
                continue
            if a not in cache:
                new.add(a)
            if len(a) < len(w):
                b = w[len(a) :]
                plain.append((w, a, b))
                if b not in cache:
                    new.add(b)
        parts = list(new)
        cache.update(zip(parts, self.merger.merge(parts)))
        for w, a, b in plain:
            cache[w] = cache[a] + cache[b]
        cache.update(zip(other, self._by_library(other)))

    def _by_library(self, words: list[bytes]) -> list[bytes]:
        got = self.lib.encode_batch_fast([w.decode() for w in words], add_special_tokens=False) if words else ()
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def _words(self, text: bytes) -> list[bytes]:
        """Lower-case words of a text; a special literal of the tokenizer is its key in ``literals``."""
        if self.literal is None or not self.literal.search(text):
            return text.lower().split()
        out = []
        for n, part in enumerate(self.literal.split(text)):
            out += [b" " + part] if n % 2 else part.lower().split()
        return out

    def _ids(self, words: list[bytes]) -> list[bytes]:
        trim(self.cache, CACHE_WORDS)
        self.cache.update(self.literals)
        self._fill(set(words).difference(self.cache))
        return list(map(self.cache.__getitem__, words))

    def _by_word(self, text: bytes) -> bytes:
        return b"".join(self._ids(self._words(text)))

    def _block(self, texts: list[bytes]) -> list[bytes]:
        """Texts without special literals: words are parted from the marks at their end and
        numbered in numpy; only distinct parts that are not known yet are merged."""
        joined = b" ".join(texts).lower()
        buf = np.frombuffer(joined, np.uint8)
        inside = np.flatnonzero(~IS_SPACE[buf])
        begin = np.flatnonzero(np.diff(inside, prepend=-2) > 1)  # a word's first byte, among the bytes of words
        starts, lens = inside[begin], np.diff(begin, append=len(inside))
        del begin
        # a word of letters and marks at its end is two parts, any other word is one
        last = np.arange(len(buf), dtype=np.int32)
        last[IS_MARK[buf]] = -1
        letters_to = np.maximum.accumulate(last, out=last)[starts + lens - 1].astype(np.int64) + 1
        strange = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(~IS_LETTER[buf], out=strange[1:])
        plain = (letters_to > starts) & (strange[np.maximum(letters_to, starts)] == strange[starts])
        del last, strange
        front = np.where(plain, letters_to - starts, lens)
        word_at = np.repeat(starts, 2)
        starts, lens = np.stack([starts, starts + front], 1).ravel(), np.stack([front, lens - front], 1).ravel()
        whole, some = np.repeat(~plain, 2)[lens > 0], lens > 0
        starts, lens, word_at = starts[some], lens[some], word_at[some]
        power, inverse = _powers(len(buf))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(buf) + 1, np.uint64)
            np.multiply(buf, power[: len(buf)], out=sums[1:])
            sums[1:] += power[: len(buf)]
            np.cumsum(sums, out=sums)
            h = (sums[starts + lens] - sums[starts]) * inverse[starts]
        del sums
        _, rep, number = np.unique(h, return_index=True, return_inverse=True)
        if not (lens[rep][number] == lens).all():
            return list(map(self._by_word, texts))  # two parts of one hash
        twin = np.repeat(starts[rep][number] - starts, lens)
        twin += inside
        if not (buf[twin] == buf[inside]).all():
            return list(map(self._by_word, texts))
        del twin, inside
        starts, lens, h, whole = starts[rep], lens[rep], h[rep], whole[rep]
        cache = self.parts
        cache.trim(CACHE_WORDS)
        place, there = cache.find(h, buf, starts, lens)
        first, size = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        first[there], size[there] = cache.first[place[there]], cache.size[place[there]]
        new, other = np.flatnonzero(~there & ~whole), np.flatnonzero(~there & whole)
        flat = cache.ids
        if len(new) or len(other):
            ids, first[new], size[new] = self.merger.merge_at(buf, starts[new], lens[new])
            more = self._by_library([joined[a : a + n] for a, n in zip(starts[other].tolist(), lens[other].tolist())])
            size[other] = [len(x) // 4 for x in more]
            first[other] = len(ids) + np.cumsum(size[other]) - size[other]
            new = np.flatnonzero(~there)
            first[new] += len(flat)
            flat = np.concatenate([flat, ids, np.frombuffer(b"".join(more), "<u4")])
            cache.add(place[new], h[new], buf, starts[new], lens[new], flat, first[new], size[new])
        count = size[number]
        ends = np.concatenate([[0], np.cumsum(count)])
        got = flat[spans(first[number], count)]
        text_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cut = ends[np.searchsorted(word_at, text_at)].tolist()
        return [got[a:b].tobytes() for a, b in zip(cut, cut[1:])]

    def _long(self, text: bytes) -> bytes:
        """A text beyond a block, cut at white space, which no token crosses."""
        out, at = [], 0
        while at < len(text):
            m = SPACE.search(text, at + BLOCK_BYTES)
            end = m.start() if m else len(text)
            part = text[at:end]
            out += [self._by_word(part)] if len(part) > 2 * BLOCK_BYTES else self._block([part])
            at = end
        return b"".join(out)

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit integers."""
        out, block, n = [b""] * len(texts), [], 0

        def flush():
            for k, ids in zip(block, self._block([texts[k] for k in block]) if block else ()):
                out[k] = ids
            block.clear()

        for k, text in enumerate(texts):
            if self.literal is not None and self.literal.search(text):
                out[k] = self._by_word(text)
            elif len(text) > BLOCK_BYTES:
                out[k] = self._long(text)
            else:
                if n + len(text) > BLOCK_BYTES:
                    flush()
                    n = 0
                block.append(k)
                n += len(text) + 1
        flush()
        return out


@lru_cache(maxsize=1)
def _all_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (base, pow(base, -1, 1 << 64)))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse, for at least ``n`` places."""
    return _all_powers(n if n > BLOCK_BYTES + 1 else BLOCK_BYTES + 1)


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids (little-endian unsigned 32-bit)."""

    @F.arrow_udf("array<struct<piece int, start bigint, length bigint, ids binary>>")
    def cut(col: pa.Array) -> pa.Array:
        give_back()
        texts = [x or b"" for x in col.to_pylist()]
        tail = np.array([end_id], "<u4").tobytes()
        rows = []
        for ids in tokenizer(path).encode_many(texts):
            ids += tail
            rows.append([(k, at // 4, len(part) // 4, part) for k, at in enumerate(range(0, len(ids), 4 * capacity)) for part in [ids[at : at + 4 * capacity]]])
        flat = [p for r in rows for p in r]
        values = pa.StructArray.from_arrays([pa.array([p[j] for p in flat], t.type) for j, t in enumerate(PIECE)], fields=list(PIECE))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values)

    # marked non-deterministic, or the optimiser's filter on the generator's input tokenizes every text once more
    cutted = docs.select(F.col(id_col).alias("__id"), cut.asNondeterministic()(F.col(text).cast("binary")).alias("__pieces"))
    return cutted.select(F.col("__id").alias(id_col), F.inline("__pieces"))


def best_fit(lens: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; bins as lists of positions."""
    bins, free = [], []  # free: sorted (slack, bin)
    for i in sorted(range(len(lens)), key=lambda i: (-lens[i], i)):
        k = bisect_left(free, (lens[i], -1))
        if k < len(free):
            slack, b = free.pop(k)
            bins[b].append(i)
        else:
            slack, b = capacity, len(bins)
            bins.append([i])
        if slack > lens[i]:
            insort(free, (slack - lens[i], b))
    return bins


def best_exchange(src: list[int], dst: list[int], slack: int, lens: list[int]) -> tuple[int, tuple, tuple]:
    """(gain of dst, what leaves src, what leaves dst) of the best move or exchange that fits."""
    best = (0, (), ())
    for n, x in enumerate(src):
        a = lens[x]
        if best[0] < a <= slack:
            best = (a, (x,), ())
        for m, y in enumerate(dst):
            d = a - lens[y]
            if best[0] < d <= slack:
                best = (d, (x,), (y,))
            for z in dst[m + 1 :]:
                if best[0] < d - lens[z] <= slack:
                    best = (d - lens[z], (x,), (y, z))
            for w in src[n + 1 :]:
                if best[0] < d + lens[w] <= slack:
                    best = (d + lens[w], (x, w), (y,))
    return best


def local_search(bins: list[list[int]], lens: list[int], capacity: int, search_bins: int = SEARCH_BINS) -> list[list[int]]:
    """Empty bins by moves and exchanges that raise the sum of squared fills, until no source is
    left that one helps. A pair of bins is tried again only if one of them has changed."""
    fill = [sum(lens[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    clock, changed, tried = 0, [0] * len(bins), [-1] * len(bins)
    moved = True
    while moved and sum(map(bool, bins)) > least:
        moved = False
        under = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: (fill[b], b))
        for n, s in enumerate(under):
            if moved and n % search_bins == 0:
                break
            seen, tried[s] = tried[s], clock
            for d in reversed(under):
                if not bins[s]:
                    break
                if changed[s] <= seen and changed[d] <= seen:
                    continue
                if d == s or not fill[d] or fill[d] >= capacity or (fill[d], d) < (fill[s], s):
                    continue
                gain, out, back = best_exchange(bins[s], bins[d], capacity - fill[d], lens)
                if gain:
                    bins[d] = [i for i in bins[d] if i not in back] + list(out)
                    bins[s] = [i for i in bins[s] if i not in out] + list(back)
                    fill[d] += gain
                    fill[s] -= gain
                    clock += 1
                    changed[s] = changed[d] = clock
                    moved = True
            if sum(map(bool, bins)) <= least:
                break
    return [b for b in bins if b]


def _shard_packer(capacity: int):
    def pack_shard(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__len", "__row"], ascending=[False, True])
        rows, lens = pdf["__row"].to_numpy(np.int64), pdf["__len"].to_numpy(np.int64).tolist()
        bins = local_search(best_fit(lens, capacity), lens, capacity)
        if len(bins) > -(-sum(lens) // capacity):
            came: dict[int, list[int]] = {}
            for i, b in enumerate(pdf["__bin"].to_numpy(np.int64).tolist()):
                came.setdefault(b, []).append(i)
            if len(came) < len(lens):
                bins = min(local_search(list(came.values()), lens, capacity), bins, key=len)
        out = []
        for b, items in enumerate(bins):
            at, total = 0, sum(lens[i] for i in items)
            for i in items:
                out.append((rows[i], lens[i], key[0], b, at, (capacity - total) * OPEN_SLACK > capacity))
                at += lens[i]
        return pd.DataFrame(out, columns=["__row", "__len", "shard", "bin", "offset", "open"])

    return pack_shard


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (lengths of 1 to ``capacity``) with sequence_id and offset.

    Columns of those two names in the input are replaced; all others are carried through.
    """
    prepare(pieces.sparkSession)
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    # the row itself is one struct, whose columns clash with nothing
    all_ = staged(pieces.select(F.struct(*keep).alias("__p"), F.monotonically_increasing_id().alias("__row")), "pieces")
    size = F.col("__p")[length]
    todo = all_.where(size < capacity).select("__row", size.cast("long").alias("__len"), F.col("__row").alias("__bin"))
    placed, round_, n = [], 0, todo.count()
    open_bins = n  # bins that the round's pieces stand in: one a piece at first
    while n:
        shards = -(-n // SHARD_ITEMS)
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64("__bin", F.lit(round_)), F.lit(shards)))
        done = staged(
            dealt.groupBy("shard").applyInPandas(_shard_packer(capacity), "__row long, __len long, shard long, bin long, offset long, open boolean"),
            f"packed-{round_}",
        )
        first = F.col("offset") == 0  # one row a bin
        bins, open_now, left = done.agg(F.count_if(first), F.count_if(first & F.col("open")), F.count_if("open")).first()
        last = shards == 1 or left == 0 or (round_ > 0 and bins >= open_bins)
        closed = done if last else done.where("not open")
        local = F.col("shard") * F.lit(1 << 20) + F.col("bin")
        placed.append(closed.select(F.col("__row").alias("__r"), (F.lit(round_) * F.lit(1 << 56) + local).alias("sequence_id"), "offset"))
        if last:
            break
        todo, n, open_bins, round_ = done.where("open").select("__row", "__len", local.alias("__bin")), left, open_now, round_ + 1
    full = all_.where(size >= capacity)
    out = full.select("__p.*", (-F.col("__row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = all_.where(size < capacity)
    for p in placed[1:]:
        placed[0] = placed[0].unionByName(p)
    if placed:
        out = out.unionByName(rest.join(placed[0], rest["__row"] == placed[0]["__r"]).select("__p.*", "sequence_id", "offset"))
    return out
