"""URL rules by a Bloom filter cascade.

Every URL asks for a few keys: its host and parent domains, each with the beginnings of its path
at the lengths that rules have. The corpus's complete key universe is known, so the first Bloom
filter encodes the listed keys, the second the universe's false positives of the first, the
third the listed keys that the second passes by mistake, and so on until none is left. From then
on membership is exact for every key of the universe, and URLs are judged by filter look-ups
alone, without a join. One cascade holds the allowed and one the blocked keys; of a URL's listed
keys the longest one decides (then the one with the longer host), and a URL without one gets the
method's verdict for what is not listed: allow.

Only listed keys that the universe holds are encoded. A level's false-positive rate follows from the
keys it must tell apart, so that its mistakes stay below the number of keys it encodes, whatever the
universe's size. A level's bits lie in segments; a segment is set in one task from its own keys.
Keys are dealt by hash into groups of about ``GROUP_KEYS`` listed ones, each with a cascade of its own,
so a broadcast holds one group (some 60 bits a listed key at most, and 8 times the root of the universe) however long the list is. Each
group is one pass over the URLs, without a shuffle; lists of up to ``GROUP_KEYS`` take one pass.

Edge cases: null URLs and URLs without ``://`` have an empty host and path and fit no rule; a rule
of an empty host fits nothing; of equal keys in both lists block wins; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, staged

GROUP_KEYS = 4_000_000
SEGMENT_BITS = 1 << 23
LEAST_HASHES = 5  # a level passes at most about 1 of 32 other keys
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
ALLOW, BLOCK = 1, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, URL, 1), UPPER, LOWER), F.regexp_extract(text, URL, 2)


class Bloom:
    """One level: ``bits`` are the segments' bits, each of ``seg_bits``."""

    def __init__(self, level: int, encoded: int, others: int, bits: np.ndarray | None = None):
        """For ``encoded`` keys against ``others``: at most about half as many mistakes as keys."""
        self.level = level
        self.hashes = max(LEAST_HASHES, math.ceil(math.log2(max(1.0, 2 * others / max(1, encoded)))))
        # two hashes give a filter of m bits m * m patterns, which must outnumber the other keys by far
        need = max(64, math.ceil(encoded * self.hashes * 1.45), math.ceil(8 * math.sqrt(others)))
        self.segments = -(-need // SEGMENT_BITS)
        self.seg_bits = -(-need // self.segments) + 7 & ~7
        self.bits = bits

    def _mixed(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            a = (h[:, 0] ^ np.uint64(self.level * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
            a ^= a >> np.uint64(33)
            b = (h[:, 1] + np.uint64(self.level)) * np.uint64(0xC4CEB9FE1A85EC53) | np.uint64(1)
            return a, b ^ (b >> np.uint64(29))

    def segment(self, h: np.ndarray) -> np.ndarray:
        a, b = self._mixed(h)
        return ((b >> np.uint64(20)) % np.uint64(self.segments)).astype(np.int64)

    def _places(self, h: np.ndarray):
        """Places inside the key's segment."""
        a, b = self._mixed(h)
        with np.errstate(over="ignore"):
            for k in range(self.hashes):
                yield ((a + np.uint64(k) * b) % np.uint64(self.seg_bits)).astype(np.int64)

    def set_segment(self, h: np.ndarray) -> bytes:
        """The bits of one segment with the keys ``h``."""
        bits = np.zeros(self.seg_bits, bool)
        for at in self._places(h):
            bits[at] = True
        return np.packbits(bits).tobytes()

    def passes(self, h: np.ndarray) -> np.ndarray:
        ok, base = np.ones(len(h), bool), self.segment(h) * self.seg_bits
        for at in self._places(h):
            at = base + at
            ok &= (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return ok


def is_member(levels: list[Bloom], h: np.ndarray) -> np.ndarray:
    """The first level that rejects a key tells: a key rejected by an even level isn't listed."""
    out = np.full(len(h), len(levels) % 2 == 1)
    open_ = np.arange(len(h))
    for n, level in enumerate(levels):
        ok = level.passes(h[open_])
        out[open_[~ok]] = n % 2 == 1
        open_ = open_[ok]
    return out


def _hashes(keys: Column) -> list[Column]:
    return [F.xxhash64(keys).alias("h1"), F.xxhash64(keys, F.lit("second")).alias("h2")]


def _pairs(*columns: pa.Array) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1).view(np.uint64)


def _level(encoded: DataFrame, level: Bloom) -> Bloom:
    """The level with its bits: keys are dealt to their segments, and each segment is set in a task."""

    @F.arrow_udf("long")
    def segment(h1: pa.Array, h2: pa.Array) -> pa.Array:
        return pa.array(level.segment(_pairs(h1, h2)), pa.int64())

    def fill(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"segment": [key[0]], "bits": [level.set_segment(pdf[["h1", "h2"]].to_numpy(np.int64).view(np.uint64))]})

    parts = encoded.select("h1", "h2", segment("h1", "h2").alias("segment")).groupBy("segment").applyInPandas(fill, "segment long, bits binary")
    size = level.seg_bits // 8
    bits = np.zeros(level.segments * size, np.uint8)
    for p in parts.collect():  # bits of one group's level
        bits[p["segment"] * size :][:size] = np.frombuffer(p["bits"], np.uint8)
    level.bits = bits
    return level


def _passing(keys: DataFrame, level: Bloom) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value.passes(_pairs(b.column("h1"), b.column("h2")))))

    return keys.mapInArrow(keep, keys.schema)


def build_cascade(encoded: DataFrame, others: DataFrame) -> list[Bloom]:
    """Filters that tell ``encoded`` from ``others`` (both: distinct keys as ``h1``, ``h2``)."""
    levels: list[Bloom] = []
    n, m = encoded.count(), others.count()
    while n or not levels:
        levels.append(_level(encoded, Bloom(len(levels), n, m)))
        encoded, others = staged(_passing(others, levels[-1]), f"cascade-{len(levels)}"), encoded
        n, m = encoded.count(), n
    return levels


def candidate_keys(host: Column, path: Column, path_lengths: list[int], labels: int) -> Column:
    """Keys that a URL asks for, the longest first: structs of (size, host size, key)."""
    parts = F.split(host, r"\.", -1)
    count = F.size(parts)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(count, F.lit(max(1, labels)))), lambda n: F.array_join(F.slice(parts, count - n + 1, n), ".")
    )
    sized = F.filter(F.array(*[F.lit(n) for n in path_lengths]), lambda n: n <= F.length(path))
    keys = F.flatten(
        F.transform(
            suffixes,
            lambda s: F.transform(
                sized, lambda n: F.struct((F.length(s) + n).alias("size"), F.length(s).alias("host"), F.concat(s, F.substr(path, F.lit(1), n)).alias("key"))
            ),
        )
    )
    return F.sort_array(F.filter(keys, lambda k: k["host"] > 0), asc=False)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict of every page. ``rules``: host, path, verdict (allow or block)."""
    spark = prepare(pages.sparkSession)
    rules = staged(rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''"), "rules")
    shape = rules.agg(F.collect_set(F.length("path")).alias("n"), F.max(F.size(F.split("host", r"\.", -1))).alias("labels")).first()
    lengths, labels = sorted(shape.n) or [0], shape.labels or 1
    host, path = host_and_path(F.col(url))
    asked = pages.select(F.col(id_col).alias("__id"), host.alias("host"), path.alias("path"))
    asked = asked.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths, labels))
    keys = rules.groupBy(F.concat("host", "path").alias("key")).agg(F.max("verdict").alias("verdict"))  # block over allow
    universe = asked.select(F.explode("keys.key").alias("key")).distinct().join(keys, "key", "left")
    universe = staged(universe.select(*_hashes(F.col("key")), "verdict"), "universe")
    longest = max([0, *(r["n"] for r in universe.where("verdict IS NOT NULL").groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect())])
    groups = max(1, -(-longest // GROUP_KEYS))
    got = asked.withColumn("h1", _key_hashes(0)).withColumn("h2", _key_hashes(1)).withColumn("mark", F.transform("keys", lambda k: F.lit(0).cast("tinyint")))
    for g in range(groups):
        own = universe.where(F.pmod(F.col("h2"), F.lit(groups)) == g)
        lists = {v: build_cascade(own.where(F.col("verdict") == v), own.where(~F.col("verdict").eqNullSafe(F.lit(v)))) for v in ("block", "allow")}
        got = got.withColumn("mark", _marker(spark, lists, g, groups)("h1", "h2", "mark"))
        if g + 1 < groups:
            got = staged(got, f"marked-{g}")  # no task holds the filters of two groups
    discard(universe)
    at = F.array_position(F.transform("mark", lambda m: m > 0), True).cast("int")
    got = got.withColumn("at", F.when(at > 0, at))
    rule, mark = F.try_element_at(F.col("keys.key"), F.col("at")), F.try_element_at(F.col("mark"), F.col("at"))
    verdict = F.when(mark == BLOCK, F.lit("block")).when(mark == ALLOW, F.lit("allow")).otherwise(F.lit(default))
    return got.select(F.col("__id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _marker(spark, lists: dict[str, list[Bloom]], group: int, groups: int):
    """A column function: the marks of a URL's keys, those of ``group`` looked up in its filters."""
    shared = spark.sparkContext.broadcast(lists)

    @F.arrow_udf("array<tinyint>")
    def mark(h1: pa.Array, h2: pa.Array, marks: pa.Array) -> pa.Array:
        h = _pairs(h1.flatten(), h2.flatten())
        out = marks.flatten().to_numpy(zero_copy_only=False).copy()
        own = np.flatnonzero(h[:, 1].view(np.int64) % groups == group)
        for name, code in (("allow", ALLOW), ("block", BLOCK)):
            out[own[is_member(shared.value[name], h[own])]] = code
        ends = np.cumsum([0, *(n or 0 for n in h1.value_lengths().to_pylist())])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int8()))

    return mark


def _key_hashes(n: int) -> Column:
    return F.transform("keys", lambda k: _hashes(k["key"])[n])

