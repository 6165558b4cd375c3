import math

import numpy as np
import pytest

import spindle.llm.embeddings as M
from spindle.llm.queries import REGISTRY


def brute(rows):
    good = [i for i, (v, x, lab) in enumerate(rows) if v is not None and lab is not None and x and all(c is not None and math.isfinite(c) for c in x) and any(x)]
    near = {i: [] for i in range(len(rows))}
    for i in good:
        for j in good:
            a, b = rows[i], rows[j]
            if i != j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float64), np.array(b[1], np.float64)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    near[i].append(j)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            seen |= group
            least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            for j in group:
                out[j] = (rows[j][0], len(near[j]), least, rows[j][0] is not None and rows[j][0] == least)
    return sorted(out, key=repr)


@pytest.mark.parametrize("cell,block", [(2000, 8000), (8, 8000), (40, 20)])
def test_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(M, "CELL_ROWS", cell)
    monkeypatch.setattr(M, "BLOCK_ROWS", block)
    g = np.random.default_rng(3)
    seeds = g.normal(size=(30, 6)).astype(np.float32)
    rows = []
    for i in range(260):
        x = (seeds[g.integers(0, 30)] + g.normal(scale=g.choice([0, 0.05, 0.2, 0.4]), size=6)).astype(np.float32)
        rows.append((i, [float(v) for v in x], int(g.integers(0, 2)) if i % 9 else 0))
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 6, 0), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (304, [float("nan")] * 6, 1), (305, [float("inf")] + [0.0] * 5, 1)]
    rows += [(306, rows[0][1], None), (None, rows[0][1], 0), (5, rows[5][1], rows[5][2]), (7, rows[8][1], rows[8][2]), (307, [1.0, 0.0], 0), (308, [2.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in M.embedding_groups(df).collect()), key=repr)
    assert got == brute(rows)
    assert M.embedding_groups(df.limit(0)).collect() == []


def test_query(spark, sf="/root/testdata/sf0.001"):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in REGISTRY["op10_embeddings"](spark, sf).collect()), key=repr)
    assert got == brute(rows)
