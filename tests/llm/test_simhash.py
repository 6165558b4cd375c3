import numpy as np
import xxhash

import spindle.llm.simhash as S
from spindle.llm.queries import REGISTRY


def brute_print(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(docs):
    fp = {i: brute_print(t) for i, t in docs}
    ids = sorted(fp)
    arr = np.array([fp[i] for i in ids], np.uint64)
    comp = list(range(len(ids)))
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 2
    changed = True
    while changed:
        new = [min(comp[j] for j in np.flatnonzero(near[i])) for i in range(len(ids))]
        changed, comp = new != comp, new
    return {i: (f"{fp[i]:016x}", ids[c]) for i, c in zip(ids, comp)}


def test_query_is_brute_force(spark, monkeypatch, sf="/root/testdata/sf0.001"):
    monkeypatch.setattr(S, "SHARD_ROWS", 16)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in REGISTRY["op5_simhash"](spark, sf).collect()}
    assert got == brute(docs)


def test_links_of_random_prints(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_ROWS", 64)
    monkeypatch.setattr(S, "BLOCK_ROWS", 100)
    monkeypatch.setattr(S, "BRUTE", 16)
    g = np.random.default_rng(1)
    seeds = g.integers(0, 1 << 63, 200).astype(np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds[:120]:
        x = int(s)
        for _ in range(g.integers(1, 8)):
            x ^= 1 << int(g.integers(0, 63))
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    comp = {r.node: r.component for r in S.connected_components(S.near_links(nodes, 2)).collect()}
    arr = np.array(fps, np.uint64)
    f = S.Forest(len(fps))
    f.union(*np.nonzero(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 2))
    p = f.flatten()
    assert {x: comp.get(x, x) for x in fps} == {x: fps[p[i]] for i, x in enumerate(fps)}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (None, "x y"), (None, "x y"), (7, "w " * 50000), (4, "a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in S.simhash_groups(df).collect()), key=repr)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, None), (None, None), (7, 7), (4, 4)], key=repr)
    assert S.simhash_groups(df.limit(0)).collect() == []
