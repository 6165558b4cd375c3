"""Connected components and block-wise comparison, shared by the near-duplicate operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst longs); component = smallest node.

    Alternating large-star and small-star steps: each is an aggregation with partial results and
    one join, the edge set never grows beyond its first size, and the number of rounds grows
    with the logarithm of the longest path. Every round ends in a table in the shared folder.
    """
    e = staged(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    before = None
    while True:
        seen = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(seen) == before or not seen[0]:
            break
        before = tuple(seen)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = staged(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(e, large)
        e = small
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def in_blocks(rows: DataFrame, cell: list[str], own: str, home: str, block_rows: int) -> DataFrame:
    """Deal the rows of each cell to comparison blocks of bounded size.

    ``rows`` holds, for each cell, the rows at home there and visitors from other cells (``home``
    false). Every row must meet every home row of its cell. A cell of up to ``block_rows`` rows is
    one block; a larger one is cut into k chunks (by a hash of ``own``), and block (q, i) compares
    chunk q with the home rows of chunk i. Adds ``__q``, ``__i``, ``__chunk``: a row is a query
    of its block if ``__chunk = __q`` and an item if it is at home and ``__chunk = __i``.
    """
    sizes = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
    k = F.ceil(F.col("__n") / F.lit(block_rows)).cast("int")
    r = rows.join(sizes, cell).withColumn("__k", k).drop("__n")
    r = r.withColumn("__chunk", F.pmod(F.xxhash64(own), F.col("__k")).cast("int"))
    return r.select(
        *rows.columns,
        "__chunk",
        F.inline(
            F.expr(
                f"""concat(
                  transform(sequence(0, __k - 1), i -> named_struct('__q', __chunk, '__i', i)),
                  CASE WHEN {home} THEN transform(filter(sequence(0, __k - 1), q -> q <> __chunk), q -> named_struct('__q', q, '__i', __chunk))
                       ELSE array() END)"""
            )
        ),
    )


class Forest:
    """Union-find over 0..n-1 in numpy; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def flatten(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            p = self.flatten()
            ra, rb = p[a], p[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))
