"""Byte-level BPE encoding and decoding.

A text is cut into pieces by the vocabulary's pattern; each piece's bytes are merged pair by
pair, lowest rank first and leftmost among equals. The pairs' ranks are the leaves of a segment
tree over the byte positions whose root is the leftmost minimum; a merge writes three leaves
(the merged position, the dead one and the left neighbour) and repairs their paths, so it costs
the logarithm of the piece's length. Trees of pieces of like length lie in one numpy block and
advance together. Whole words repeat, so a bounded cache maps a word to its ids.

Edge cases: null text is empty; an empty text has no ids; a piece that is itself in the
vocabulary is one id, as in the usual libraries; unknown ids in ``decode`` raise.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 400_000
BLOCK_CHARS = 1 << 20
MARKS = frozenset(".,;:!?")
INF = np.int64(1) << np.int64(62)
# white space of the pattern: the Unicode property
UNSAFE = re.compile(r" (?=\s)| $")  # \s holds a few characters more; those texts are cut with care
SAFE_CUT = regex.compile(r" (?=\P{White_Space})")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def all_pairs(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """Every way to make a token of two tokens."""
    parts = ((ranks.get(token[:k]), ranks.get(token[k:]), r) for token, r in ranks.items() for k in range(1, len(token)))
    return [(a, b, r) for a, b, r in parts if a is not None and b is not None]


class PairTable:
    """rank of the token that two adjacent tokens make, for arrays of token ids."""

    def __init__(self, pairs: list[tuple[int, int, int]], width: int):
        """``pairs``: (left id, right id, merged id); a lower merged id has precedence."""
        keys, out = [a * width + b for a, b, _ in pairs], [r for _, _, r in pairs]
        self.width = np.int64(width)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.vals = np.full(1 << bits, -1, np.int64), np.full(1 << bits, INF, np.int64)
        keys, out = np.array(keys, np.int64), np.array(out, np.int64)
        at = self._home(keys)
        while len(keys):  # open addressing: of those that want a free slot the last one gets it
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys
            self.vals[at[won]] = out[won]
            keys, out, at = keys[~won], out[~won], (at[~won] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = self._home(key)
        have = self.keys[at]
        val = np.where(have == key, self.vals[at], INF)
        open_ = np.flatnonzero((have != key) & (have != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            have = self.keys[at[open_]]
            hit = have == key[open_]
            val[open_[hit]] = self.vals[at[open_[hit]]]
            open_ = open_[~hit & (have != -1)]
        return val


def trim(cache: dict, most: int) -> None:
    """Forget the newer half of a full cache; frequent words are met early, so they stay."""
    if len(cache) > most:
        for word in list(cache)[most // 2 :]:
            del cache[word]


class Merger:
    """Merges of byte strings, block by block; ``first`` gives the ids of the single bytes and
    ``last`` those of a piece's last byte (the same, unless the vocabulary marks ends)."""

    def __init__(self, pairs: PairTable, first: np.ndarray, last: np.ndarray):
        self.pairs, self.first, self.last = pairs, first, last

    def _merge_block(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Ids (int32 bytes) of pieces of 1 to ``size`` bytes, ``size`` a power of two."""
        m = len(pieces)
        lens = np.fromiter(map(len, pieces), np.int64, m)
        code = np.full((m, size), -1, np.int64)
        inside = np.arange(size) < lens[:, None]
        code[inside] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        code[np.arange(m), lens - 1] = self.last[np.fromiter((p[-1] for p in pieces), np.int64, m)]
        nxt = np.tile(np.arange(1, size + 1, dtype=np.int64), (m, 1))
        nxt[nxt >= lens[:, None]] = size
        prv = np.tile(np.arange(-1, size - 1, dtype=np.int64), (m, 1))
        tree = np.full((m, 2 * size), INF, np.int64)
        r, c = np.nonzero(inside[:, 1:])
        rank = self.pairs.get(code[r, c], code[r, c + 1])
        tree[r, size + c] = np.where(rank < INF, rank * size + c, INF)
        k = size // 2
        while k:
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
            k //= 2
        flat, code_, nxt_, prv_ = tree.reshape(-1), code.reshape(-1), nxt.reshape(-1), prv.reshape(-1)
        act = np.arange(m)
        while True:
            root = flat[act * (2 * size) + 1]
            live = root < INF
            act, root = act[live], root[live]
            if not len(act):
                break
            i, rank = root % size, root // size
            base, tbase = act * size, act * (2 * size)
            j = nxt_[base + i]
            k = nxt_[base + j]
            code_[base + i] = rank
            code_[base + j] = -1
            nxt_[base + i] = k
            has_k = k < size
            prv_[(base + k)[has_k]] = i[has_k]
            p = prv_[base + i]
            has_p = p >= 0
            right = np.full(len(act), INF, np.int64)
            got = self.pairs.get(rank[has_k], code_[(base + k)[has_k]])
            right[has_k] = np.where(got < INF, got * size + i[has_k], INF)
            flat[tbase + size + i] = right
            flat[tbase + size + j] = INF
            pp = p[has_p]
            got = self.pairs.get(code_[base[has_p] + pp], rank[has_p])
            flat[tbase[has_p] + size + pp] = np.where(got < INF, got * size + pp, INF)
            for start, at in ((tbase, size + i), (tbase, size + j), (tbase[has_p], size + pp)):
                node = at >> 1
                while len(node) and node[0]:
                    flat[start + node] = np.minimum(flat[start + 2 * node], flat[start + 2 * node + 1])
                    node = node >> 1
        keep = code >= 0
        ids = code[keep].astype(np.int32).tobytes()
        ends = np.cumsum(keep.sum(axis=1) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (int32 bytes) of each piece."""
        out: list = [None] * len(pieces)
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        power = np.maximum(1, np.ceil(np.log2(np.maximum(lens, 1)))).astype(np.int64)
        for k in np.unique(power):
            members, size = np.flatnonzero(power == k).tolist(), 1 << int(k)
            step = max(1, (1 << 18) // size)
            for a in range(0, len(members), step):
                part = members[a : a + step]
                for n, ids in zip(part, self._merge_block([pieces[n] for n in part], size)):
                    out[n] = ids
        return out


class Encoder(Merger):
    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        super().__init__(PairTable(all_pairs(self.ranks), max(self.ranks.values()) + 1), single, single)
        self.cache: dict[str, bytes] = {}  # of a word after a space
        self.pieces: dict[str, bytes] = {}
        self.single = {r: np.array([r], np.int32).tobytes() for r in self.ranks.values()}
        n = max(self.ranks.values()) + 1
        self.tokens = [None] * n
        for token, r in self.ranks.items():
            self.tokens[r] = token

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        whole = [self.ranks.get(p) for p in pieces]
        rest = iter(self.merge([p for p, r in zip(pieces, whole) if r is None]))
        return [next(rest) if r is None else self.single[r] for r in whole]

    def _fill(self, words: list[str]) -> list[bytes]:
        find = self.pattern.findall
        # a space and letters are one piece, and a mark at their end another; others need the pattern
        pieces = [
            [w] if w[1:].isalpha() and w[0] == " " else [w[:-1], w[-1]] if w[-1:] in MARKS and w[1:-1].isalpha() and w[0] == " " else find(w)
            for w in words
        ]
        known, spaced = self.pieces, self.cache
        ids = {p: known.get(p) or (spaced.get(p[1:]) if p[0] == " " else None) for ps in pieces for p in ps}
        new = [p for p, x in ids.items() if x is None]
        ids.update(zip(new, self.encode_pieces([p.encode() for p in new])))
        out = [b"".join([ids[p] for p in ps]) for ps in pieces]
        known.update((p, ids[p]) for p in new if len(p) <= 2)  # marks and endings, that many words share
        return out

    def _encode_block(self, texts: list[str], keep: bool) -> list[bytes]:
        # Parts whose pieces don't depend on each other: cut before a space that stands before
        # other than white space. But for the first, parts lack the space they begin with.
        parts = [SAFE_CUT.split(t) if UNSAFE.search(t) else t.split(" ") for t in texts]
        cache = self.cache if keep else {}
        found = [list(map(cache.get, ps)) for ps in parts]
        open_ = [(n, k) for n, ids in enumerate(found) for k, x in enumerate(ids) if x is None and k]
        new = list({parts[n][k] for n, k in open_})
        cache.update(zip(new, self._fill([" " + w for w in new])))
        for n, k in open_:
            found[n][k] = cache[parts[n][k]]
        for ids, first in zip(found, self._fill([ps[0] for ps in parts])):
            ids[0] = first  # it lacks no space
        return [b"".join(ids) for ids in found]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """ids of each text as int32 bytes."""
        out, a = [], 0
        while a < len(texts):
            b, n = a, 0
            while b < len(texts) and (b == a or n + len(texts[b]) <= BLOCK_CHARS):
                n += len(texts[b])
                b += 1
            trim(self.cache, CACHE_WORDS)
            trim(self.pieces, CACHE_WORDS)
            out += self._encode_block(texts[a:b], keep=n <= BLOCK_CHARS)  # one huge text fills no cache
            a = b
        return out


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder, with its cache, for each Python worker."""
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with a column ``out`` of token ids (array<int>); a column of that name is replaced."""

    @F.arrow_udf("array<int>")
    def ids(col: pa.Array) -> pa.Array:
        got = encoder(path, pattern).encode_many([x or "" for x in col.to_pylist()])
        lens = np.fromiter(map(len, got), np.int64, len(got)) // 4
        offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(got), np.int32)))

    return docs.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with a column ``out`` of the bytes (binary) that the ids stand for; null ids: no bytes."""

    @F.arrow_udf("binary")
    def text(col: pa.Array) -> pa.Array:
        tokens = encoder(path, pattern).tokens
        flat = col.flatten().to_numpy()
        ends = np.cumsum([0, *[x or 0 for x in col.value_lengths().to_pylist()]])
        return pa.array([b"".join([tokens[t] for t in flat[a:b].tolist()]) for a, b in zip(ends[:-1], ends[1:])], pa.binary())

    return df.withColumn(out, text(F.col(ids)))


def ids_digest(ids: str) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(F.col(ids), " "), 256)
