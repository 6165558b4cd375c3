"""SimHash near-duplicates by vantage-point trees.

Fingerprints: 64 majority bits over the hashes of a text's word shingles. Equal fingerprints
are one node, so groups of copies collapse before anything is compared. A vantage-point tree
over a bounded sample cuts the space into shards: at each node a fingerprint goes left if its
distance to the vantage point is at most the median, else right; by the triangle inequality only
those within the search radius of that boundary have partners on the other side, and these visit
the other shard as queries. Inside a shard the same tree goes on down to blocks that are
compared bit by bit. A shard reports a spanning forest of its links and never all pairs.

The sample only places boundaries; results do not depend on it. Shards over the block size are
cut into blocks (``in_blocks``), so no task holds an unbounded group.

Edge cases: null and wordless texts have fingerprint 0 and link like any other; fewer words than
a shingle: the whole sequence is one; null ids never name a component (a component of null ids
only has a null one); repeated rows share all; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, prepare, staged
from .components import Forest, connected_components, in_blocks

SAMPLE = 20_000
SHARD_ROWS = 4096
BLOCK_ROWS = 50_000
BRUTE = 256


def fingerprint(text: str | None, n: int = 3) -> int:
    """Signed 64-bit SimHash of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= n:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
        stops = (ends - 1)[n - 1 :].tolist()
        h = xxhash.xxh64_intdigest
        hashes = np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, len(stops))
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 3) -> DataFrame:
    """(``__id``, ``fp``) of every document."""

    @F.arrow_udf("long")
    def fp(col: pa.Array) -> pa.Array:
        give_back()
        return pa.array((fingerprint(x.as_py(), n) for x in col), pa.int64())

    return docs.select(F.col(id_col).cast("long").alias("__id"), fp(F.col(text)).alias("fp"))


def hamming(a: np.ndarray, b: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def build_tree(sample: np.ndarray, leaves: int):
    """Nested (vantage point, median, left, right); an int names a leaf."""
    names = iter(range(1 << 40))

    def grow(part: np.ndarray, want: int):
        if want <= 1 or len(part) < 2:
            return next(names)
        vp = part[0]  # the sample is in hash order, so this is an arbitrary member
        d = hamming(part, vp)
        mu = int(np.median(d))
        left = d <= mu
        if left.all():
            mu = int(d.max()) - 1
            left = d <= mu
            if mu < 0:
                return next(names)
        return vp, mu, grow(part[left], want // 2), grow(part[~left], want - want // 2)

    return grow(sample, leaves)


def route(tree, fps: np.ndarray, radius: int):
    """(positions, leaf, at home) of every shard that each fingerprint belongs to or visits."""
    out = []

    def walk(node, at: np.ndarray, home: np.ndarray):
        if not len(at):
            return
        if not isinstance(node, tuple):
            out.append((at, np.full(len(at), node, np.int64), home))
            return
        vp, mu, left, right = node
        d = hamming(fps[at], vp).astype(np.int64)
        near, far = d <= mu + radius, d > mu - radius
        walk(left, at[near], home[near] & (d[near] <= mu))
        walk(right, at[far], home[far] & (d[far] > mu))

    walk(tree, np.arange(len(fps)), np.ones(len(fps), bool))
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def link(fps: np.ndarray, items: np.ndarray, queries: np.ndarray, radius: int, forest: Forest) -> None:
    """Join every query with the items within the radius; all are positions in ``fps``."""
    if not len(items) or not len(queries):
        return
    if len(items) > BRUTE:
        vp = fps[items[len(items) // 2]]
        d = hamming(fps[items], vp).astype(np.int64)
        mu = int(np.median(d))
        mu -= (d <= mu).all()
        left = d <= mu
        if left.any():
            dq = hamming(fps[queries], vp).astype(np.int64)
            link(fps, items[left], queries[dq <= mu + radius], radius, forest)
            link(fps, items[~left], queries[dq > mu - radius], radius, forest)
            return
    step = max(1, (1 << 20) // len(items))
    for a in range(0, len(queries), step):
        q = queries[a : a + step]
        x, y = np.nonzero(np.bitwise_count(fps[q][:, None] ^ fps[items][None, :]) <= radius)
        forest.union(q[x], items[y])


def near_links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Spanning edges (src, dst) of all links between distinct fingerprints (column ``fp``)."""
    spark = nodes.sparkSession
    n = nodes.count()
    leaves = max(1, -(-n // SHARD_ROWS))
    sample = np.array([r.fp for r in nodes.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    tree = spark.sparkContext.broadcast(build_tree(sample, min(leaves, SAMPLE // 16)))

    def deal(batches):
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False)
            at, leaf, home = route(tree.value, fps.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int64)), pa.array(fps[at]), pa.array(home.astype(bool))], ["leaf", "fp", "home"])

    def search(key, pdf: pd.DataFrame) -> pd.DataFrame:
        give_back()
        fps = np.sort(pdf["fp"].to_numpy(np.int64))
        forest = Forest(len(fps))
        mine = pdf.sort_values("fp")
        chunk, q, i = (mine[c].to_numpy() for c in ("__chunk", "__q", "__i"))
        items = np.flatnonzero((chunk == i) & mine["home"].to_numpy(bool))
        link(fps.view(np.uint64), items, np.flatnonzero(chunk == q), radius, forest)
        p = forest.flatten()
        tied = p != np.arange(len(p))
        return pd.DataFrame({"src": fps[tied], "dst": fps[p[tied]]})

    rows = nodes.select("fp").mapInArrow(deal, "leaf long, fp long, home boolean")
    blocks = in_blocks(rows, ["leaf"], "fp", "home", BLOCK_ROWS)
    return blocks.groupBy("leaf", "__q", "__i").applyInPandas(search, "src long, dst long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id)."""
    prepare(docs.sparkSession)
    prints = staged(with_fingerprint(docs, id_col, text, shingle), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(F.min("__id").alias("first")), "nodes")
    comp = connected_components(near_links(nodes, radius))
    nodes_ = nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = nodes_.groupBy("root").agg(F.min("first").alias("component_id"))
    named = staged(nodes_.join(least, "root").select(F.col("fp").alias("__fp"), "component_id"), "components")
    discard(nodes)
    out = prints.join(named, prints["fp"] == named["__fp"])
    return out.select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
