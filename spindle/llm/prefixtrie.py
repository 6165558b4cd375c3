"""Prefix trie of conversations as balanced parentheses, shard by shard.

A turn is the MD5 of its role and text, a conversation the path of its turns, a node of the trie a
distinct sequence of first turns. Texts never move: only digests and lengths do. Paths are sorted
(start, path, conversation) and cut into shards of about ``SHARD_NODES`` nodes, so paths that share a prefix
are neighbours, and a hot prefix or a conversation copied any number of times spreads over shards. A
shard writes its trie in preorder as parentheses; blocks keep the least and greatest excess, in a
tree above them. ``findclose`` gives the end of every node's subtree, the rank of "()" pairs its leaves, and
cumulative arrays over the preorder its members and savings.

Only nodes on a shard's first and last path, its spines, are shared with other shards. All figures of
a spine node are sums of what its shards hold once each node is counted by one shard: as a child
and for its length by the first shard it is in, as a leaf by the last. Which nodes those are follows
from the number of turns that neighbouring shards' paths have in common. So one grouping by node
merges the spines.

Paths of more than ``CHUNK`` turns are cut, and the sub-trie below a cut is a trie of its own whose
totals enter the node above it; the rounds are the longest conversation's chunks, and no row or task
holds a whole conversation of any length. Positions in a conversation come from a range sort, whose
partitions carry on the count of a conversation they share.

SHA-256 over a node's members is a chain by definition: each shard writes its part of the list and
one task reads a node's parts in order, holding one part at a time.

Edge cases: null role and text are empty; a null turn comes first, equal turn numbers follow by
digest; repeated rows are turns of their own; rows without a conversation id belong to no
conversation and are left out; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, staged

CHUNK = 512
SHARD_NODES = 200_000
WIDTH = 16  # bytes of a digest
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
BUILT = f"kind int, shard int, key binary, parent_key binary, part string, {NODE}"
KIND_NODE, KIND_SPINE, KIND_ROOT = 0, 1, 2


class Parens:
    """Balanced parentheses (1 opens) with a tree of least and greatest excess over blocks."""

    BLOCK = 64

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        pad = -len(bits) % self.BLOCK
        blocks = np.concatenate([self.excess, np.full(pad, self.excess[-1] if len(bits) else 0)]).reshape(-1, self.BLOCK)
        self.least, self.most = [blocks.min(1)], [blocks.max(1)]
        while len(self.least[-1]) > 1:
            for side, join in ((self.least, np.minimum), (self.most, np.maximum)):
                x = side[-1]
                x = np.append(x, x[-1:]) if len(x) % 2 else x
                side.append(join(x[::2], x[1::2]))

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Position of the parenthesis that closes each opening one."""
        want, out = self.excess[at] - 1, at + 1
        todo = self._in_block(out, want, np.arange(len(at)))
        if len(todo):
            out[todo] = self._block(out[todo] // self.BLOCK, want[todo]) * self.BLOCK
            self._in_block(out, want, todo)
        return out

    def _in_block(self, out, want, todo):
        """Walk on to the wanted excess; those that reach the next block first are given back."""
        left = []
        first = True
        while len(todo):
            if not first:
                edge = out[todo] % self.BLOCK == 0
                left.append(todo[edge])
                todo = todo[~edge]
            todo = todo[self.excess[out[todo]] != want[todo]]
            out[todo] += 1
            first = False
        return np.concatenate(left) if left else todo

    def _block(self, b, want):
        """The first block from ``b`` on that holds the wanted excess."""
        level = np.zeros(len(b), np.int64)
        todo = np.arange(len(b))
        while len(todo):  # up: to the next subtree on the right until one holds it
            todo = todo[~self._holds(level[todo], b[todo], want[todo])]
            b[todo] += 1
            up = todo[b[todo] % 2 == 0]
            b[up] //= 2
            level[up] += 1
        todo = np.flatnonzero(level > 0)
        while len(todo):  # down: the left half unless only the right one holds it
            b[todo] *= 2
            level[todo] -= 1
            b[todo] += ~self._holds(level[todo], b[todo], want[todo])
            todo = todo[level[todo] > 0]
        return b

    def _holds(self, level, b, want):
        out = np.zeros(len(b), bool)
        for k in np.unique(level):
            at = level == k
            out[at] = (self.least[k][b[at]] <= want[at]) & (want[at] <= self.most[k][b[at]])
        return out


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return (int(x.argmax()) if x.any() else n) // WIDTH


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def build_shard(shard: int, above: int, rows: list[tuple], before: int, after: int) -> list[tuple]:
    """Rows of ``BUILT`` for one shard, whose roots lie ``above`` turns deep.

    ``rows``: (start, path, conv, sizes, ends here, extra children, leaves and savings below the path's end), sorted.
    ``before``, ``after``: turns that the first path shares with the path before the shard, the last
    path with that after it; -1 if they start elsewhere.
    """
    starts, paths, convs = [r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows], np.int64)
    depth_of = np.array([len(p) // WIDTH + 1 for p in paths])  # nodes of a path, its root included
    shared = np.array([0] + [common_turns(p, q) + 1 if s == t else 0 for s, t, p, q in zip(starts, starts[1:], paths, paths[1:])])
    opened = depth_of - shared
    closed = np.append(0, depth_of[:-1]) - shared
    closed[0] = 0
    bits = np.repeat(np.tile(np.array([0, 1], np.uint8), len(rows)), np.stack([closed, opened], 1).ravel())
    bits = np.append(bits, np.zeros(depth_of[-1], np.uint8))
    n = int(opened.sum())
    row = np.repeat(np.arange(len(rows)), opened)
    depth = np.arange(n) - np.repeat(np.cumsum(opened) - opened - shared, opened)
    end = np.cumsum(opened) - 1  # node at which a row's path ends: rows that open none repeat the path before
    size = np.array([rows[r][3][d - 1] if d else 0 for r, d in zip(row.tolist(), depth.tolist())], np.int64)
    parent, stack = np.zeros(n, np.int64), []
    for r, (s, k) in enumerate(zip(shared.tolist(), opened.tolist())):
        del stack[s:]
        for node in range(end[r] - k + 1, end[r] + 1):
            parent[node] = stack[-1] if stack else -1
            stack.append(node)
    first_path, last_path = list(range(int(depth_of[0]))), stack

    own = np.ones(n, bool)
    own[first_path[: before + 1]] = False
    tree = Parens(bits)
    at = np.flatnonzero(bits)
    close = tree.findclose(at)
    node, after_ = np.arange(n), np.arange(n) + (close - at + 1) // 2
    pair = np.zeros(len(bits), np.int64)
    pair[:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
    if after + 1 >= len(last_path):
        pair[at[last_path[-1]]] = 0  # the next shard goes on from here, with the same path or a longer one
    extra = np.zeros((3, n), np.int64)
    for r, e in zip(rows, end.tolist()):
        if r[5] is not None:
            pair[at[e]] = 0
            extra[:, e] = r[5:8] if own[e] else 0
    rank = _sums(pair)
    members = _sums(np.bincount(end, minlength=n))
    convs_below = members[after_] - members[node]
    below = _sums(extra[1])
    leaves = rank[close + 1] - rank[at] + below[after_] - below[node]
    saving = _sums(convs_below * size - own * size + extra[2])
    saved = saving[after_] - saving[node]
    children = np.bincount(parent[own & (parent >= 0)], minlength=n) + extra[0]

    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, end, convs)
    least = least.tolist()
    for k in range(n - 1, 0, -1):
        p = parent[k]
        if p >= 0 and least[k] < least[p]:
            least[p] = least[k]
    ends: dict[int, list[str]] = {}
    for r, e in zip(rows, end.tolist()):
        if r[4]:
            ends.setdefault(e, []).append(str(r[2]))

    spine = {*first_path, *last_path}
    key: dict[int, bytes] = {}

    def key_of(k: int) -> bytes:
        if k not in key:
            key[k] = hashlib.md5(starts[row[k]] + paths[row[k]][: WIDTH * int(depth[k])]).digest()
        return key[k]

    none = hashlib.sha256(b"").hexdigest()
    out = []
    for k in range(n):
        p, part = int(parent[k]), ",".join(ends.get(k, ()))
        root, on_spine, below_spine = p < 0, k in spine, p in spine
        figures = (int(convs_below[k]), int(children[k]), int(leaves[k]), int(saved[k]))
        place = (least[k], above + int(depth[k]))
        if on_spine:
            out.append((KIND_SPINE, shard, key_of(k), None if root else key_of(p), part, *place, None, *figures, None))
        elif root:
            out.append((KIND_ROOT, shard, key_of(k), None, "", *place, None, *figures, None))
        else:
            sha = hashlib.sha256(part.encode()).hexdigest() if part else none
            out.append((KIND_NODE, shard, None, key_of(p) if below_spine else None, "", *place, None if below_spine else least[p], *figures, sha))
    return out


# ---------------------------------------------------------------- turns


def numbered_turns(conversations: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, digest, bytes) of every turn; positions from 0 in each conversation."""
    who, what = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what)))
    turns = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(what).cast("long").alias("bytes")
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")]

    def number(batches):
        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            c = b.column("conv").to_numpy(zero_copy_only=False)
            if not len(c):
                continue
            begin = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            count = np.diff(np.append(begin, len(c)))
            pos = np.arange(len(c)) - np.repeat(begin, count)
            if c[0] == last:
                pos[: count[0]] += n
            last, n = c[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(pos, pa.int64()), b.column("digest"), b.column("bytes"), pa.array(np.full(len(c), part), pa.int32())], ["conv", "pos", "digest", "bytes", "part"])

    rows = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(rows.mapInArrow(number, "conv long, pos long, digest binary, bytes long, part int"), "turns")
    # a conversation may lie over partitions: three numbers of each give the turns before it
    bounds = rows.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "pos")).alias("last")).collect()
    carry, conv, count = [], None, 0
    for b in sorted(bounds, key=lambda b: b["part"]):
        count = count if b["first"] == conv else 0
        if count:
            carry.append((b["part"], b["first"], count))
        count, conv = (count if b["last"]["conv"] == b["first"] else 0) + b["last"]["pos"] + 1, b["last"]["conv"]
    if not carry:
        return rows.drop("part")
    more = F.broadcast(rows.sparkSession.createDataFrame(carry, "part int, conv long, __more long"))  # at most one row a task
    return rows.join(more, ["part", "conv"], "left").select("conv", (F.col("pos") + F.coalesce("__more", F.lit(0))).alias("pos"), "digest", "bytes")


# ---------------------------------------------------------------- trie


def _chunks(turns: DataFrame, members: DataFrame) -> DataFrame:
    """(conv, chunk, start, next, path, sizes): ``start`` names the node above the chunk (empty:
    the root), ``next`` the node at its end if the conversation goes on."""
    place = F.struct("pos", "digest", "bytes")
    got = turns.groupBy("conv", F.floor(F.col("pos") / CHUNK).cast("int").alias("chunk")).agg(F.sort_array(F.collect_list(place)).alias("x"))
    got = got.select(
        "conv", "chunk", F.unhex(F.array_join(F.transform("x", lambda e: F.hex(e["digest"])), "")).alias("path"), F.transform("x", lambda e: e["bytes"]).alias("sizes")
    )
    top = members.select(F.col("conv").cast("long").alias("conv")).distinct().join(got.where("chunk = 0").drop("chunk"), "conv", "left")
    top = top.select("conv", F.lit(0).alias("chunk"), F.coalesce("path", F.lit(b"")).alias("path"), F.coalesce("sizes", F.array().cast("array<bigint>")).alias("sizes"))
    rows = staged(top.unionByName(got.where("chunk > 0")), "chunks")
    if not rows.where("chunk > 0").limit(1).count():
        return rows.withColumn("start", F.lit(b"")).withColumn("next", F.lit(None).cast("binary"))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        start, out = b"", []
        for conv, chunk, digest in zip(pdf["conv"], pdf["chunk"], pdf["digest"]):
            after = hashlib.md5(start + digest).digest()
            out.append([conv, chunk, start, after])
            start = after
        out[-1][3] = None
        return pd.DataFrame(out, columns=["conv", "chunk", "start", "next"])

    long_ = rows.where("chunk = 1").select("conv")
    links = rows.join(long_, "conv", "left_semi").select("conv", "chunk", F.unhex(F.md5("path")).alias("digest"))
    links = links.groupBy("conv").applyInPandas(chain, "conv long, chunk int, start binary, next binary")  # one digest a chunk
    return staged(rows.join(links, ["conv", "chunk"], "left").withColumn("start", F.coalesce("start", F.lit(b""))), "chains")


def _shards(rows: DataFrame, nodes: int) -> DataFrame:
    """Sorted paths with their shard and what it shares with its neighbours."""
    spark, order = rows.sparkSession, ["start", "path", "conv"]
    paths = rows.repartitionByRange(max(1, -(-nodes // SHARD_NODES)), *order).withColumn("shard", F.spark_partition_id())
    paths = staged(paths, "paths")
    edge = F.struct("start", "path")
    bounds = staged(paths.groupBy("shard").agg(F.min(edge).alias("first"), F.max(edge).alias("last")), "bounds")
    ids = sorted(r[0] for r in bounds.select("shard").collect())  # a number a shard

    @F.arrow_udf("int")
    def shared(s1: pa.Array, p1: pa.Array, s2: pa.Array, p2: pa.Array) -> pa.Array:
        return pa.array([common_turns(b, d) if a == c else -1 for a, b, c, d in zip(*(x.to_pylist() for x in (s1, p1, s2, p2)))], pa.int32())

    pairs = spark.createDataFrame(list(zip(ids, ids[1:])), "shard int, after int")
    low = bounds.select("shard", F.col("last.start").alias("s1"), F.col("last.path").alias("p1"))
    high = bounds.select(F.col("shard").alias("after"), F.col("first.start").alias("s2"), F.col("first.path").alias("p2"))
    links = staged(pairs.join(low, "shard").join(high, "after").select("shard", "after", shared("s1", "p1", "s2", "p2").alias("turns")), "links")
    links_up = F.broadcast(links.select("shard", F.col("turns").alias("__after")))  # two numbers a shard
    links_down = F.broadcast(links.select(F.col("after").alias("shard"), F.col("turns").alias("__before")))
    out = paths.join(links_down, "shard", "left").join(links_up, "shard", "left")
    return out.fillna(-1, ["__before", "__after"])


def _digests(batches):
    """SHA-256 of each key's parts, which come in order; a key's rows lie in one task."""
    key, sha, names = None, None, ["key", "sha"]
    for b in batches:
        out = []
        for k, part in zip(b.column("key").to_pylist(), b.column("part").to_pylist()):
            if k == key:
                sha.update(b"," + part.encode())
            else:
                if key is not None:
                    out.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(part.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], names)


def _level(rows: DataFrame, level: int, nodes: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, totals of the roots by key) of all sub-tries that begin with chunk ``level``."""

    above = level * CHUNK

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        cols = [pdf[c].tolist() for c in ("start", "path", "conv", "sizes", "next", "x_children", "x_leaves", "x_saved")]
        got = [(s, p, c, z, nx is None, *(None if pd.isna(v) else int(v) for v in x)) for s, p, c, z, nx, *x in zip(*cols)]
        got.sort(key=lambda r: r[:3])
        out = build_shard(int(key[0]), above, got, int(pdf["__before"].iloc[0]), int(pdf["__after"].iloc[0]))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in BUILT.split(", ")])
        return frame.astype({"parent_conv_id": "Int64"})

    built = staged(_shards(rows, nodes).groupBy("shard").applyInPandas(build, BUILT), "trie")
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    spine = built.where(f"kind = {KIND_SPINE}")
    sums = spine.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), *[F.sum(c).alias(c) for c in figures])
    parts = spine.where("part <> ''").select("key", "shard", "part").repartition("key").sortWithinPartitions("key", "shard")
    merged = staged(sums.join(parts.mapInArrow(_digests, "key binary, sha string"), "key", "left"), "spines")
    up = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    names = [c.split()[0] for c in NODE.split(", ")]
    none = F.lit(hashlib.sha256(b"").hexdigest())
    spines = merged.join(up, "parent_key", "left").withColumn("ends_sha256", F.coalesce("sha", none))
    if level:
        spines = spines.where("parent_key IS NOT NULL")
    found = built.where(f"kind = {KIND_NODE}")
    # the parents on the spines by shard too: a node with very many children is met shard by shard
    near = spine.select("shard", F.col("key").alias("parent_key")).join(up, "parent_key")
    below = found.where("parent_key IS NOT NULL").drop("parent_conv_id").join(near, ["shard", "parent_key"])
    out = found.where("parent_key IS NULL").select(*names).unionByName(below.select(*names)).unionByName(spines.select(*names))
    roots = built.where(f"kind = {KIND_ROOT}").select("key", *figures).unionByName(merged.where("parent_key IS NULL").select("key", *figures))
    return out, roots


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node of the trie.

    ``turns``: (conv, pos, digest, bytes), positions of a conversation gapless from 0 (as
    ``numbered_turns`` gives them). ``members``: (conv), every conversation, turnless ones too.
    """
    spark = prepare(turns.sparkSession)
    rows = _chunks(turns, members)
    levels = {r[0]: r[1] for r in rows.groupBy("chunk").agg(F.sum(F.size("sizes") + 1)).collect()}
    out, roots = spark.createDataFrame([], NODE), None
    for level in sorted(levels, reverse=True):
        own = rows.where(F.col("chunk") == level).drop("chunk")
        extra = [F.lit(None).cast("long").alias(f"x_{c}") for c in ("children", "leaves", "saved")]
        if roots is not None:
            x = roots.select(F.col("key").alias("__k"), F.col("n_children").alias("x_children"), F.col("n_leaves").alias("x_leaves"), F.col("saved_tokens").alias("x_saved"))
            own = own.join(x, F.unhex(F.md5("next")) == F.col("__k"), "left").drop("__k")
        else:
            own = own.select("*", *extra)
        nodes, roots = _level(own, level, levels[level])
        out = out.unionByName(nodes)
    return out
