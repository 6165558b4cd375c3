import zlib

import numpy as np

import spindle.llm.quality as Q
from spindle.llm.quality import FEATURES, fit, quality_scores, statistics
from spindle.llm.queries import REGISTRY


def test_trees_learn_and_walk():
    g = np.random.default_rng(0)
    x = g.normal(size=(3000, len(FEATURES)))
    y = ((x[:, 2] > 0.3) ^ (x[:, 5] > 0)).astype(float)
    m = fit(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    row = x[2500:2501]  # one row walked by hand
    b = m.binned(row)[0]
    total = m.base
    for f, c, v in zip(m.feature, m.bin, m.value):
        node = 0
        while node < len(f):
            node = 2 * node + 1 + int(b[f[node]] > c[node])
        total += v[node - len(f)]
    assert abs(m.score(row)[0] - 1 / (1 + np.exp(-total))) < 1e-12


def test_held_out_accuracy(spark, sf="/root/testdata/sf0.01"):
    got = {r.doc_id: r for r in REGISTRY["op6_quality"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    out = [(r.predicted, labels[i]) for i, r in got.items() if r.held_out and i in labels]
    assert np.mean([a == b for a, b in out]) > 0.95, np.mean([a == b for a, b in out])


def test_odd_rows(spark):
    assert not statistics(None).any()
    docs = spark.createDataFrame([(1, None, 2.0), (2, "", 1.0), (None, "a b", 0.0), (2, "", 1.0), (3, "x" * 100000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert quality_scores(docs.limit(0), labels.limit(0)).collect() == []


def test_repeats_do_not_crowd_out_the_draw(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "fit", lambda x, y: seen.append((x, y)))
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    # a labelled id whose rows are many short texts, labels that repeat
    docs = [(ids[0], f"a{n}") for n in range(100)] + [(i, "long word " * i) for i in ids[1:]] * 2
    labels = [(ids[0], 0)] * 90 + [(i, i % 2) for i in ids[1:]]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    Q.train(docs, labels, max_rows=60)
    Q.train(docs, labels, max_rows=10_000)
    (x, y), (all_x, all_y) = seen
    assert len(y) == 60 and len(all_y) == 100 + len(ids) - 1
    assert set(y) == {0, 1} and x[:, 0].max() > np.log1p(100)
