"""Exact de-duplication against a minimal perfect hash over historical digests.

History is the set of distinct digests of texts seen before, each with its winner (smallest id)
and group size. It is cut into shards by digest; each shard becomes one minimal perfect hash:
a seed per bucket sends every digest of the shard to a slot of its own, and the slot holds the
full 32-byte digest and the winner's id. A lookup computes the slot, compares all 32 bytes and
either returns the winner or says the digest is no member; nonmembers are grouped separately.

Hot digests (more than 1/1000 of the rows each, so fewer than 1000 of them) are looked up in an
index of their own that is broadcast, without any shuffle. Shards are cut by distinct digests, so
the rows that look one up are unbounded (many mid-sized groups of copies, a history smaller than
the rows): they are counted per shard and dealt by row number, not by digest, to parts of about
``PROBE_ROWS``, each with the shard's index. No task holds more than that. Only digests move.

Edge cases: null text counts as empty; rows repeated in id and text are one document and share
its decision; null ids take part, are never the winner unless all ids of the group are null
(keep_id is null then and ``kept`` false); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, discard, give_back, prepare, staged, text_or_empty

SHARD_ROWS = 50_000
PROBE_ROWS = 200_000  # rows that look up one copy of a shard's index
BUCKET = 4  # mean digests per seed of the perfect hash
HOT_SHARE = 1000  # a digest with more than 1/1000 of the rows is hot
NO_ID = np.iinfo(np.int64).min

INDEX_SCHEMA = "shard long, n int, seeds binary, digests binary, winners binary, sizes binary"


def _words(digests: np.ndarray) -> tuple[np.ndarray, ...]:
    """Four 64-bit words of each 32-byte digest."""
    w = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
    return w[:, 0], w[:, 1], w[:, 2], w[:, 3]


def _slot(words, seeds: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = words[1] ^ (seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27)) ^ words[2]) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x % np.uint64(n)).astype(np.int64)


def build_mph(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed per bucket, slot of each digest) of n distinct 32-byte digests; slots are 0..n-1."""
    n = len(digests)
    words = _words(digests)
    n_buckets = max(1, -(-n // BUCKET))
    bucket = (words[0] % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    seeds = np.zeros(n_buckets, np.uint32)
    slots = np.full(n, -1, np.int64)
    taken = np.zeros(n, bool)
    tries = np.arange(4096, dtype=np.uint64)
    for b in np.argsort(-(starts[1:] - starts[:-1]), kind="stable"):
        members = order[starts[b] : starts[b + 1]]
        if not len(members):
            break
        base = 0
        while True:  # the largest buckets come first, so a fitting seed is found soon
            block = tries[: 64 if base == 0 else 4096] + np.uint64(base)
            cand = np.stack([_slot([w[m : m + 1] for w in words], block, n) for m in members], axis=1)
            ok = ~taken[cand].any(axis=1)
            if cand.shape[1] > 1:
                s = np.sort(cand, axis=1)
                ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            hit = np.flatnonzero(ok)
            if len(hit):
                seeds[b] = base + hit[0]
                slots[members] = cand[hit[0]]
                taken[cand[hit[0]]] = True
                break
            base += len(block)
    return seeds, slots


def _build_shard(key, pdf: pd.DataFrame) -> pd.DataFrame:
    digests = np.frombuffer(b"".join(pdf["digest"]), np.uint8).reshape(-1, 32)
    seeds, slots = build_mph(digests)
    at = np.empty(len(pdf), np.int64)
    at[slots] = np.arange(len(pdf))
    winner = pdf["winner"].astype("Int64").fillna(NO_ID).astype(np.int64).to_numpy()
    row = (key[0], len(pdf), seeds.tobytes(), digests[at].tobytes(), winner[at].tobytes(), pdf["size"].to_numpy(np.int64)[at].tobytes())
    return pd.DataFrame([row], columns=["shard", "n", "seeds", "digests", "winners", "sizes"])


class Shard:
    """A loaded perfect hash."""

    def __init__(self, row):
        self.n = int(row["n"])
        self.seeds = np.frombuffer(row["seeds"], np.uint32)
        self.digests = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        self.winners = np.frombuffer(row["winners"], np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)

    def lookup(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is member, slot) by the slot's full digest."""
        words = _words(digests)
        bucket = (words[0] % np.uint64(len(self.seeds))).astype(np.int64)
        slot = _slot(words, self.seeds[bucket], self.n)
        return (self.digests[slot] == digests).all(axis=1), slot


def _answer(pdf: pd.DataFrame, shard: Shard | None) -> pd.DataFrame:
    n = len(pdf)
    member, keep, size = np.zeros(n, bool), np.full(n, NO_ID), np.zeros(n, np.int64)
    if shard is not None and n:
        digests = np.frombuffer(b"".join(pdf["digest"]), np.uint8).reshape(-1, 32)
        member, slot = shard.lookup(digests)
        keep = np.where(member, shard.winners[slot], NO_ID)
        size = np.where(member, shard.sizes[slot], 0)
    ids = pd.Series(keep, dtype="Int64")
    return pd.DataFrame(
        {"__id": pdf["__id"].astype("Int64"), "digest": pdf["digest"], "keep_id": ids.mask(ids == NO_ID), "group_size": size, "member": member}
    )


ANSWER = "__id long, digest binary, keep_id long, group_size long, member boolean"


def _probe(key, rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    give_back()
    return _answer(rows, Shard(index.iloc[0]) if len(index) else None)


def with_digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``__id`` and the SHA-256 of each text with runs of white space made one space."""
    normal = F.regexp_replace(text_or_empty(text), ASCII_SPACE, " ")
    return docs.select(F.col(id_col).cast("long").alias("__id"), F.unhex(F.sha2(normal, 256)).alias("digest"))


def summarise(digests: DataFrame) -> DataFrame:
    """History of a set of rows: one row per distinct digest with winner and size."""
    return digests.groupBy("digest").agg(F.min("__id").alias("winner"), F.count(F.lit(1)).alias("size"))


def _sharded(df: DataFrame, n_shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(n_shards)))


def lookup(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Answer of the history's perfect hash for each row of (``__id``, ``digest``)."""
    spark = rows.sparkSession
    n, distinct = history.agg(F.sum("size"), F.count(F.lit(1))).first()
    n_shards = max(1, -(-distinct // SHARD_ROWS))
    hot = history.where(F.col("size") * HOT_SHARE > F.lit(n or 0))  # fewer than HOT_SHARE rows
    hot_index = _sharded(hot, 1).groupBy("shard").applyInPandas(_build_shard, INDEX_SCHEMA).collect()
    blob = spark.sparkContext.broadcast(hot_index[0].asDict() if hot_index else None)

    def hot_lookup(batches):
        shard = Shard(blob.value) if blob.value else None
        for pdf in batches:
            yield _answer(pdf, shard)

    first = rows.mapInPandas(hot_lookup, ANSWER)
    index = _sharded(history.where(F.col("size") * HOT_SHARE <= F.lit(n or 0)), n_shards).groupBy("shard").applyInPandas(_build_shard, INDEX_SCHEMA)
    rest = _sharded(first.where(~F.col("member")).select("__id", "digest"), n_shards)
    cold = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    parts = staged(_sharded(cold, n_shards).groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(PROBE_ROWS)).alias("parts")), "parts")
    many = F.broadcast(parts.where("parts > 1"))  # at most a row per SHARD_ROWS digests or PROBE_ROWS rows
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1)))  # equal rows get different parts
    dealt = rest.join(many, "shard", "left").select("__id", "digest", "shard", part.alias("part"))
    last = F.coalesce("parts", F.lit(1)) - 1
    copies = index.join(many, "shard", "left").select(*index.columns, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    second = dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInPandas(_probe, ANSWER)
    return first.where("member").unionByName(second)


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest.

    With ``history`` (from ``summarise``) rows it knows are repeats of its winners and the
    others are grouped among themselves; without, the history is that of ``docs`` itself.
    """
    spark = prepare(docs.sparkSession)
    rows = staged(with_digest(docs, id_col, text), "digests")
    own = history is None
    past = staged(summarise(rows), "history") if own else history
    found = staged(lookup(rows, past), "lookup")
    new = summarise(found.where(~F.col("member"))).select(F.col("digest").alias("__d"), "winner", "size")
    alone = found.where(~F.col("member"))
    alone = alone.join(new, alone["digest"] == new["__d"], "left").select("__id", "digest", F.col("winner").alias("keep_id"), F.col("size").alias("group_size"))
    out = found.where("member").select("__id", "digest", "keep_id", "group_size").unionByName(alone)
    discard(rows)
    if own:
        discard(past)
    return out.select(
        F.col("__id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("__id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        "digest",
    )
