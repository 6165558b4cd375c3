"""The topic model as an artefact: versions, the gate before the start, damaged and empty models."""

import os

import pytest
from pyspark.sql import functions as F

from spindle.operators import topic_model as tm
from spindle.operators.topics import fit_topics, topic_terms

VECS = [(i, [1.0, 0.1 * (i % 3)] if i % 2 else [0.1 * (i % 3), 1.0]) for i in range(20)] + [(20, None), (21, [0.0, 0.0]), (1, [1.0, 0.0])]
DOCS = [(i, "apples pears plums" if i % 2 else "iron copper iron") for i in range(18)] + [(18, None), (19, ""), (99, "never seen")]


def _fit(spark, names=None, docs=DOCS):
    vecs = spark.createDataFrame(VECS, "vec int, v array<double>")
    cents = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, -1.0])], "topic_id int, centroid array<double>")
    frame = spark.createDataFrame(docs, "d int, text string")
    return tm.fit_model(cents, vecs, "vec", "v", frame, "d", "text", names=names), vecs


def _assigned(model, vecs):
    return sorted(map(tuple, model.assign(vecs, ["vec"], "v").select("vec", "topic_id", "probability").collect()))


def test_fitted_terms_and_names(spark):
    model, _ = _fit(spark, spark.createDataFrame([(1, "Metals"), (0, "0_old_name"), (7, "Unused")], "topic_id int, name string"))
    terms = {(r["topic_id"], r["rank"]): r["term"] for r in model.terms.collect()}
    assert terms[(1, 1)] == "iron" and {terms[(0, k)] for k in (1, 2, 3)} == {"apples", "pears", "plums"}
    names = dict(map(tuple, model.names.collect()))
    # a stored name stays, one of the generated form is made anew, a topic without terms is numbered
    assert names[1] == "Metals" and names[0].startswith("0_apples_") and names[2] == "Topic 2" and names[7] == "Unused"
    assert "never" not in terms.values()


def test_loaded_model_gives_the_fitted_assignments(spark, scratch):
    model, vecs = _fit(spark)
    tm.save_model(model, scratch, "v1")
    loaded = tm.load_model(spark, scratch, "v1")
    assert _assigned(loaded, vecs) == _assigned(model, vecs)
    assert sorted(map(tuple, loaded.terms.collect())) == sorted(map(tuple, model.terms.collect()))
    assert loaded.catalog.count() == model.catalog.count() == 3  # no text has an outlying vector


def test_newest_version_and_no_overwriting(spark, scratch):
    model, _ = _fit(spark)
    tm.save_model(model, scratch, "b")
    tm.save_model(model, scratch, "a")
    assert tm.load_model(spark, scratch).version == "a"
    assert tm.load_model(spark, scratch, "b").version == "b"
    with pytest.raises(ValueError, match="exists"):
        tm.save_model(model, scratch, "a")


def test_gate(spark, scratch):
    with pytest.raises(tm.ModelNotReady, match="no topic model"):
        tm.load_model(spark, scratch)
    model, vecs = _fit(spark)
    tm.save_model(model, scratch, "whole")
    with pytest.raises(tm.ModelNotReady, match="of version other"):
        tm.load_model(spark, scratch, "other")
    # a version whose writer was lost before its info is not seen, and can be written again
    model.centroids.write.parquet(f"{scratch}/half/{tm.CENTROIDS}")
    assert [r["version"] for r in tm.versions(spark, scratch)] == ["whole"]
    tm.save_model(model, scratch, "half")
    assert _assigned(tm.load_model(spark, scratch), vecs) == _assigned(model, vecs)
    # rows gone since
    model.names.limit(1).write.mode("overwrite").parquet(f"{scratch}/half/{tm.NAMES}")
    with pytest.raises(tm.ModelNotReady, match="1 rows of names"):
        tm.load_model(spark, scratch, "half")


def test_empty_model_is_refused_and_texts_may_be_missing(spark, scratch):
    model, vecs = _fit(spark, docs=[(1, None)])
    assert model.terms.count() == 0 and dict(map(tuple, model.names.collect())) == {0: "Topic 0", 1: "Topic 1", 2: "Topic 2"}
    tm.save_model(model, scratch, "no-terms")
    assert _assigned(tm.load_model(spark, scratch), vecs) == _assigned(model, vecs)
    none = model.centroids.where("false")
    empty = tm.TopicModel(none, model.terms, model.names.where("false"))
    tm.save_model(empty, scratch, "nothing")
    with pytest.raises(tm.ModelNotReady, match="0 rows of centroids"):
        tm.load_model(spark, scratch, "nothing")
    assert os.path.isdir(scratch)


def test_fit_by_clusters(spark, scratch):
    vecs = spark.createDataFrame([v for v in VECS if v[1] and any(v[1])], "vec int, v array<double>")
    cents, _, _ = fit_topics(vecs, "v", k=2)
    docs = spark.createDataFrame(DOCS, "d int, text string")
    model = tm.fit_model(cents, vecs, "vec", "v", docs, "d", "text")
    tm.save_model(model, scratch, "k2")
    loaded = tm.load_model(spark, scratch)
    assert _assigned(loaded, vecs) == _assigned(model, vecs)
    labelled = docs.join(model.assign(vecs, ["vec"], "v"), F.col("vec") == F.col("d")).select("topic_id", "text")
    want = {(r["topic_id"], r["term"]) for r in topic_terms(labelled).collect()}
    assert {(r["topic_id"], r["term"]) for r in loaded.terms.collect()} == want
