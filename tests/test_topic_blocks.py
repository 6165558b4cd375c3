"""Vector topics over blocks of centroids, and broadcasts bounded by bytes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.operators.sizing import SideTableTooLarge, row_bytes, sized_broadcast
from spindle.operators.topics import assign_topics_vector, topic_catalog, with_topic_details

T = 0.05


def _vectors(spark):
    rng = np.random.default_rng(3)
    cents = [(i, rng.normal(size=6).tolist()) for i in range(11)]
    cents += [(20, cents[4][1]), (21, [0.0] * 6)]  # a tie and a centroid without direction
    vecs = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    vecs += [(40, None), (41, [0.0] * 6), (42, [1.0, 2.0]), (43, cents[4][1]), (43, cents[4][1])]
    return spark.createDataFrame(vecs, "id int, v array<double>"), spark.createDataFrame(cents, "topic_id int, centroid array<double>"), vecs, cents


def _brute(v, cents):
    def cos(c):
        if v is None or len(v) != len(c) or not any(v) or not any(c):
            return -1.0
        return float(np.dot(v, c) / np.linalg.norm(v) / np.linalg.norm(c))

    sims = [(round(cos(c), 10), -t, cos(c)) for t, c in cents]
    _, t, best = max(sims)
    return (-t if best >= 0.15 else -1, 1 / sum(math.exp((s[2] - best) / T) for s in sims), best)


@pytest.mark.parametrize("block,passes", [(2000, 20), (3, 20), (3, 2), (1, 5)])
def test_blocks_of_centroids(spark, block, passes):
    vecs, cents, v, c = _vectors(spark)
    got = assign_topics_vector(vecs, ["id"], "v", cents, block=block, pass_blocks=passes).collect()
    got = sorted((r.id, r.topic_id, r.probability, r.best_cosine) for r in got)
    want = sorted((i, *_brute(x, c)) for i, x in v)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2:] for g in got], [w[2:] for w in want], rtol=1e-9, atol=1e-12)


def test_no_centroids(spark):
    vecs, cents, _, _ = _vectors(spark)
    with pytest.raises(SideTableTooLarge):
        assign_topics_vector(vecs, ["id"], "v", cents.limit(0))
    assert assign_topics_vector(vecs.limit(0), ["id"], "v", cents, block=3).count() == 0


def test_blocks_need_no_shuffle_of_vectors(spark):
    vecs, cents, _, _ = _vectors(spark)
    plan = assign_topics_vector(vecs, ["id"], "v", cents, block=3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_bytes_bound_a_broadcast(spark):
    df = spark.createDataFrame([(1, "x" * 1000, ["ab"], {"k": "v"}), (2, None, None, None)], "n int, `a.b` string, l array<string>, m map<string,string>")
    size = df.agg(F.sum(row_bytes(df))).first()[0]
    assert 1000 < size < 1200
    assert sized_broadcast(df, max_bytes=size)[1] and not sized_broadcast(df, max_bytes=size - 1)[1]
    assert not sized_broadcast(df, max_rows=1)[1] and sized_broadcast(df.limit(0))[1]


def test_large_catalog_is_joined(spark):
    terms = spark.createDataFrame([(0, "a", 1.0, 1), (0, "b", 0.5, 2), (1, "c", 1.0, 1)], "topic_id int, term string, weight double, rank int")
    names = spark.createDataFrame([(0, "zero"), (3, "three")], "topic_id int, name string")
    rows = spark.createDataFrame([(0, 0.5), (1, 0.5), (9, 0.1), (-1, 1.0)], "topic_id int, probability double")
    cat = topic_catalog(terms, names)
    assert cat.count() == 3
    small = sorted(map(str, with_topic_details(rows, cat).collect()))
    assert cat._small
    cat._small = False
    joined = with_topic_details(rows, cat)
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, joined.collect())) == small
