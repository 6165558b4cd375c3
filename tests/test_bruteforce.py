"""Rows-only queries checked against brute force on the smallest fixture."""

import json
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from spindle.operators.labels import char_class_model
from spindle.plans import catalog as C
from spindle.sources.fixtures import doc_feed
from spindle.sources.tables import read_table

from .conftest import SF_SMALL


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def test_keyphrase_dedup_matches_greedy_walk(spark):
    cands = C._keyphrase_candidates(spark, SF_SMALL).collect()
    by_doc = defaultdict(list)
    for r in cands:
        by_doc[r.doc_id].append((round(r.score, 10), r.phrase))
    expected = {}
    for d, lst in by_doc.items():
        kept = []
        for _, p in sorted(lst):
            if len(kept) >= 10:
                break
            if all(1 - _lev(k, p) / max(len(k), len(p)) <= 0.9 for k in kept):
                kept.append(p)
        expected[d] = kept
    got = defaultdict(list)
    for r in C.REGISTRY["keyphrases"](spark, SF_SMALL).orderBy("doc_id", "rank").collect():
        got[r.doc_id].append(r.phrase)
    assert dict(got) == expected


def test_model_scorer_matches_direct_call(spark):
    got = {(r.id, r.label): (r.rank, r.score) for r in C.REGISTRY["label_scores_model"](spark, SF_SMALL).collect()}
    feed = doc_feed(spark, SF_SMALL).select("id", "cleaned_text").collect()
    texts = [(r.id, r.cleaned_text) for r in feed if r.cleaned_text is not None and r.cleaned_text.strip()]
    labels = C.DEFAULT_LABELS
    probs = char_class_model()([t for _, t in texts], labels)
    assert len(got) == len(texts) * len(labels)
    for (i, _), p in zip(texts, probs):
        order = sorted(range(len(labels)), key=lambda k: (-round(p[k], 8), k))
        for rank, k in enumerate(order, 1):
            assert got[(i, labels[k])] == (rank, round(p[k], 6))


def test_topic_fit_assigns_nearest_centre(spark):
    from spindle.operators.topics import fit_topics

    emb = read_table(spark, SF_SMALL, "embeddings").select("vec_id", "embedding")
    cents, model, feats = fit_topics(emb, "embedding", k=10, seed=7)
    centres = np.array(model.clusterCenters())
    rows = model.transform(feats).select("vec_id", "embedding", "topic_id").collect()
    for r in rows:
        d = ((centres - np.asarray(r.embedding, dtype=float)) ** 2).sum(axis=1)
        assert d[r.topic_id] <= d.min() + 1e-9
    assert cents.count() == 10


def test_export_rows_json_shape(spark):
    from spindle.plans.common import enriched_backlog
    from spindle.sinks import results as rs

    table = rs.upsert(None, rs.result_rows(enriched_backlog(spark, SF_SMALL), batch_id=1))
    typed = {r.raw_mongo_id: r for r in table.collect()}
    for r in rs.export_rows(table).collect():
        t = typed[r.raw_mongo_id]
        if t.overall_sentiment:
            s = json.loads(r.overall_sentiment)
            assert [x["label"] for x in s] == [x.label for x in t.overall_sentiment]
        else:
            assert r.overall_sentiment is None
        topics = json.loads(r.assigned_topics)
        assert topics[0]["id"] == t.assigned_topics[0].id
        for pair, kw in zip(topics[0]["keywords"], t.assigned_topics[0].keywords):
            assert pair == [kw.term, kw.weight]
        if t.extracted_keywords_frequency:
            assert json.loads(r.extracted_keywords_frequency)[0]["keyword"] == t.extracted_keywords_frequency[0].keyword
        else:
            assert r.extracted_keywords_frequency is None
        assert r.analysis_errors is None and r.signal_extraction_status == "pending"


def test_keyphrase_dedup_drops_near_copies(spark):
    from spindle.operators.keyphrases import dedup_keyphrases

    rows = [(1, "health costs", 0.01), (1, "health cost", 0.02), (1, "drug prices", 0.03), (1, "drug price", 0.04),
            (1, "care", 0.05), (2, "a", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, phrase string, score double")
    got = [(r.doc_id, r.rank, r.phrase) for r in dedup_keyphrases(df, "doc_id", top=2).orderBy("doc_id", "rank").collect()]
    # "health cost" is 1 - 1/12 = 0.917 similar to the kept "health costs"; top=2 stops the walk
    assert got == [(1, 1, "health costs"), (1, 2, "drug prices"), (2, 1, "a")]
