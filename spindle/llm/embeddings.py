"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, one kept a group.

Equal vectors of one label are one node with a multiplicity, so groups of copies collapse first.
Cells come from spherical k-means on a bounded sample of each label (``SAMPLE`` vectors in all,
in hash order). Each node is at home in the cell of its nearest centroid and also visits every
cell that could hold a partner: for unit vectors with cosine of at least t the distance is at
most sqrt(2 - 2t), so x must visit the cell of c only if it lies that near to the plane between
its own centroid and c. That makes the search exact whatever the cells are. Cells over the block
size are compared in blocks (``in_blocks``); a block reports counts and a spanning forest.

Edge cases: a vector that is null, empty, zero or holds a null or non-finite component, a null
label and a null id link with nothing; vectors of different lengths never link; repeated rows
are vectors of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, staged
from .components import Forest, connected_components, in_blocks

SAMPLE = 20_000
CELL_ROWS = 2000
BLOCK_ROWS = 8000
ROUNDS = 8


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (by the largest component first: no overflow or underflow)."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids of unit vectors."""
    c = np.unique(x, axis=0)
    c = c[np.linspace(0, len(c) - 1, min(k, len(c))).astype(int)]
    for _ in range(ROUNDS):
        home = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        size = np.sqrt((total * total).sum(axis=1))
        c = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], c)
    return c


def cells_of(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, at home) of the cells that each unit vector belongs to or visits."""
    s = x @ c.T
    home = s.argmax(axis=1)
    gap = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))  # between centroids
    near = s[np.arange(len(x)), home][:, None] - s <= reach * gap[home] + 1e-9
    near[np.arange(len(x)), home] = True
    row, cell = np.nonzero(near)
    return row, cell, home[row] == cell


def fit_cells(nodes: DataFrame) -> dict:
    """Centroids by (label, dim); a label outside the sample is one cell."""
    n = nodes.count()
    got = nodes.select("label", "dim", "vec").orderBy(F.xxhash64("node")).limit(SAMPLE).collect()
    by: dict = {}
    for r in got:
        by.setdefault((r.label, r.dim), []).append(r.vec)
    out = {}
    for key, vecs in by.items():
        x = unit(np.array(vecs, np.float64))
        k = min(-(-n * len(x) // (len(got) * CELL_ROWS)), len(x) // 8)
        out[key] = kmeans(x, k) if k > 1 else x[:1]
    return out


def links(nodes: DataFrame, threshold: float) -> DataFrame:
    """(src, n, dst) for nodes in each block: weight of their links there and their local root."""
    spark = nodes.sparkSession
    cells = spark.sparkContext.broadcast(fit_cells(nodes))  # at most SAMPLE / 8 vectors
    reach = float(np.sqrt(2 - 2 * threshold))

    def deal(batches):
        for b in batches:
            pdf = b.to_pandas()
            for (label, dim), part in pdf.groupby(["label", "dim"]):
                x = unit(np.stack(part["vec"].to_numpy()).astype(np.float64))
                c = cells.value.get((label, dim))
                row, cell, home = cells_of(x, c, reach) if c is not None else (np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool))
                blobs = [v.tobytes() for v in x]
                yield pa.RecordBatch.from_pydict(
                    {
                        "label": np.full(len(row), label, np.int64),
                        "dim": np.full(len(row), dim, np.int32),
                        "cell": cell.astype(np.int64),
                        "home": home,
                        "node": part["node"].to_numpy()[row],
                        "mult": part["mult"].to_numpy()[row],
                        "unit": pa.array([blobs[i] for i in row], pa.binary()),
                    }
                )

    def search(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        x = np.frombuffer(b"".join(pdf["unit"]), np.float64).reshape(len(pdf), -1)
        node, mult = pdf["node"].to_numpy(np.int64), pdf["mult"].to_numpy(np.int64)
        items = np.flatnonzero((pdf["__chunk"] == pdf["__i"]).to_numpy() & pdf["home"].to_numpy(bool))
        queries = np.flatnonzero((pdf["__chunk"] == pdf["__q"]).to_numpy())
        n, forest = np.zeros(len(pdf), np.int64), Forest(len(pdf))
        step = max(1, (1 << 21) // max(1, len(items)))
        for a in range(0, len(queries), step):
            q = queries[a : a + step]
            near = x[q] @ x[items].T >= threshold
            near &= q[:, None] != items[None, :]
            n[q] += near @ mult[items]
            i, j = np.nonzero(near)
            forest.union(q[i], items[j])
        root = forest.flatten()
        some = (n > 0) | (root != np.arange(len(pdf)))
        return pd.DataFrame({"src": node[some], "n": n[some], "dst": node[root[some]]})

    schema = "label long, dim int, cell long, home boolean, node long, mult long, unit binary"
    rows = nodes.select("label", "dim", "node", "mult", "vec").mapInArrow(deal, schema)
    blocks = in_blocks(rows, ["label", "dim", "cell"], "node", "home", BLOCK_ROWS)
    return blocks.groupBy("label", "dim", "cell", "__q", "__i").applyInPandas(search, "src long, n long, dst long")


def embedding_groups(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept (one representative of each group)."""
    prepare(vectors.sparkSession)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("__id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vec")
    )
    good = F.forall("vec", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    usable = F.coalesce(F.col("__id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & good, F.lit(False))
    rows = rows.withColumn("ok", usable)
    nodes = rows.where("ok").groupBy("label", "vec").agg(F.min("__id").alias("first"), F.count(F.lit(1)).alias("mult"))
    nodes = staged(nodes.withColumns({"dim": F.size("vec"), "node": F.monotonically_increasing_id()}), "vectors")
    found = staged(links(nodes, threshold), "links")
    weight = found.groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("n"))
    comp = connected_components(found.select("src", "dst"))
    named = nodes.join(weight, "node", "left").join(comp, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select(
        F.col("label").alias("__l"), F.col("vec").alias("__v"), "component_id", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")
    )
    named = staged(named, "groups")
    discard(nodes, found)
    linked = rows.where("ok").join(named, (F.col("label") == F.col("__l")) & (F.col("vec") == F.col("__v"))).select("__id", "n_links", "component_id")
    alone = rows.where("not ok").select("__id", F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("__id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("__id") == F.col("component_id"), F.lit(False)).alias("kept"))
