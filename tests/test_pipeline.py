"""Edge rows of the analysis and its invariants."""

import datetime as dt

from pyspark.sql import functions as F

from spindle.config import ERR_TOPIC_MODEL
from spindle.operators.enrich import enrich
from spindle.operators.validate import normalize, split_valid, validate
from spindle.plans.common import fixture_models
from spindle.sources.backlog import backlog_scan, eligible, ensure_status, request_frame
from spindle.sources.fixtures import doc_feed

from .conftest import SF_SMALL

TS = dt.datetime(2024, 1, 1, 12, 0, 0)


def _req(i, text, tokens=None, lemmas=None, key=None, **kw):
    base = dict(id=i, raw_mongo_id=key or f"k{i}", source="post", original_timestamp=TS, retrieved_by_keyword="kw",
                keyword_language="ar", keyword_concept_id=None, detected_language="ar", cleaned_text=text,
                tokens_processed=tokens, lemmas=lemmas, original_url=None)
    base.update(kw)
    return base


def test_backlog_filter_keeps_null_status_and_sorts_nulls_last(spark):
    rows = [(1, None, TS), (2, "completed", TS), (3, "pending", None), (4, "failed_permanent", TS),
            (5, "pending_nlp_store_verification", TS - dt.timedelta(days=1)), (6, "failed_nlp_analysis", TS)]
    df = spark.createDataFrame(rows, "id int, nlp_status string, original_timestamp timestamp")
    assert sorted(r.id for r in eligible(df).collect()) == [1, 3, 5]
    for c in ["raw_mongo_id", "source", "retrieved_by_keyword", "keyword_language", "keyword_concept_id",
              "detected_language", "cleaned_text", "tokens_processed", "lemmas", "original_url"]:
        df = df.withColumn(c, F.lit(None).cast("string"))
    assert [r.id for r in backlog_scan(df, 2).collect()] == [5, 1]


def test_ensure_status_adds_pending(spark):
    df = spark.createDataFrame([(1,)], "id int")
    r = ensure_status(df).first()
    assert r.nlp_status == "pending" and r.nlp_status_timestamp is None


def test_absent_columns_get_defaults_but_nulls_fail(spark):
    df = spark.createDataFrame([(1, "k1", TS, "t")], "id int, raw_mongo_id string, original_timestamp timestamp, cleaned_text string")
    r = validate(normalize(df)).first()
    assert (r.source, r.retrieved_by_keyword, r.keyword_language) == ("unknown_source_type", "unknown_keyword", "un")
    assert r.is_valid
    df2 = spark.createDataFrame([(1, "k1", None, TS, "t")], "id int, raw_mongo_id string, source string, original_timestamp timestamp, cleaned_text string")
    r2 = validate(normalize(df2)).first()
    assert not r2.is_valid and "source is required" in r2.reasons


def test_enrich_edge_rows(spark):
    reqs = [
        _req(1, "Health costs are rising, costs again", tokens=["health", "costs", "are", "rising", "costs", "again"]),
        _req(2, "   ", tokens=["x"]),  # blank text: sentiment [], topic -1 (1.0), keywords from tokens
        _req(3, "Some text", tokens=None, lemmas=[]),  # no tokens at all: no keywords, no summary
        _req(4, "More text", tokens=["a", "b"], lemmas=["lem", "lem", "b"]),
    ]
    df = normalize(request_frame(spark, reqs))
    valid, bad = split_valid(validate(df))
    assert bad.count() == 0
    models = fixture_models(spark, SF_SMALL)
    out = {r.id: r for r in enrich(valid, models).collect()}
    r1 = out[1]
    assert abs(sum(s.score for s in r1.overall_sentiment) - 1.0) < 1e-9
    assert [k.keyword for k in r1.extracted_keywords_frequency][:1] == ["costs"]
    assert r1.sentiment_on_extracted_keywords_summary is not None
    assert r1.analysis_errors is None
    r2 = out[2]
    assert r2.overall_sentiment == []
    assert r2.assigned_topics[0].id == -1 and r2.assigned_topics[0].probability == 1.0
    assert [k.keyword for k in r2.extracted_keywords_frequency] == ["x"]
    assert r2.analysis_errors is None
    r3 = out[3]
    assert r3.extracted_keywords_frequency == [] and r3.sentiment_on_extracted_keywords_summary is None
    r4 = out[4]
    assert [(k.keyword, k.frequency) for k in r4.extracted_keywords_frequency] == [("lem", 2), ("b", 1)]


def test_enrich_without_topic_model_reports_error(spark):
    df = normalize(request_frame(spark, [_req(1, "text here", tokens=["text", "here"])]))
    models = fixture_models(spark, SF_SMALL, with_topics=False)
    r = enrich(validate(df).where("is_valid"), models).first()
    assert r.assigned_topics == [] and r.analysis_errors == [ERR_TOPIC_MODEL]


def test_fixture_invariants(spark):
    feed = doc_feed(spark, SF_SMALL)
    v = validate(normalize(eligible(feed)))
    total, ok, bad = v.count(), v.where("is_valid").count(), v.where("not is_valid").count()
    assert total == ok + bad and bad > 0
    e = enrich(v.where("is_valid"), fixture_models(spark, SF_SMALL))
    sums = e.select(F.aggregate("overall_sentiment", F.lit(0.0), lambda a, s: a + s["score"]).alias("s"), F.size("overall_sentiment").alias("n"))
    assert sums.where((F.col("n") > 0) & (F.abs(F.col("s") - 1.0) > 1e-9)).count() == 0
    assert e.count() == ok


def test_request_file_end_to_end(spark, scratch):
    """On-request path: a JSON-lines request file, without ids, through the same plan."""
    import json
    import os

    from spindle.sources.backlog import request_source

    lemmas = ["بُسْتَان", "قَمَر", "بُسْتَان", "نَهْر", "جَبَل", "قَمَر", "شَجَرَة", "طَرِيق", "سَمَاء", "زَهْرَة", "حَجَر", "رِيح", "مَطَر"]
    body = {"raw_mongo_id": "a" * 24, "source": "post", "original_timestamp": "2024-03-02T10:20:30Z", "retrieved_by_keyword": "بُسْتَان",
            "keyword_language": "ar", "keyword_concept_id": "b" * 24, "detected_language": "ar",
            "cleaned_text": "القمر فوق البستان والنهر تحت الجبل.", "tokens_processed": ["القمر", "البستان"], "lemmas": lemmas}
    odd = [dict(body, raw_mongo_id="odd-list", tokens_processed=["a", 1]), dict(body, raw_mongo_id="odd-text", lemmas="x"), dict(body, raw_mongo_id="odd-id", id="seven")]
    more = [dict(body, raw_mongo_id=f"k{i}", cleaned_text=f"text number {i}") for i in range(4)]
    path = os.path.join(scratch, "requests")
    os.makedirs(path)
    with open(os.path.join(path, "r.json"), "w", encoding="utf-8") as f:
        f.write("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in [body, *odd, *more]))
    req = validate(normalize(request_source(spark, path)))
    bad = {r.raw_mongo_id: list(r.reasons) for r in req.where("not is_valid").collect()}
    assert bad == {"odd-list": ["tokens_processed must be a list of strings"], "odd-text": ["lemmas must be a list of strings"], "odd-id": ["id must be an integer"]}
    out = {r.raw_mongo_id: r for r in enrich(req, fixture_models(spark, SF_SMALL), valid_col="is_valid").collect()}
    assert set(out) == {"a" * 24, "k0", "k1", "k2", "k3"}
    r = out["a" * 24]
    assert r.original_timestamp == dt.datetime(2024, 3, 2, 10, 20, 30)
    assert [(k.keyword, k.frequency) for k in r.extracted_keywords_frequency][:2] == [("بُسْتَان", 2), ("قَمَر", 2)]
    assert len(r.overall_sentiment) == 7 and r.sentiment_on_extracted_keywords_summary is not None
    assert r.original_keyword_language == "ar" and r.analysis_errors is None


def test_enrich_keeps_every_row_whatever_its_id(spark):
    reqs = [_req(None, f"text {i}", tokens=["a"], key=f"n{i}") for i in range(5)] + [_req(3_000_000_000, "x", key="b1"), _req(3_000_000_001, "y", key="b2"), _req(4, "x", key="r1"), _req(4, "y", key="r2")]
    v = validate(normalize(request_frame(spark, reqs)))
    out = enrich(v.where("is_valid"), fixture_models(spark, SF_SMALL)).collect()
    assert sorted(r.raw_mongo_id for r in out) == sorted(x["raw_mongo_id"] for x in reqs)
    assert {r.id for r in out} == {None, 3_000_000_000, 3_000_000_001, 4}


def test_length_rules_quarantine_only_offending_rows(spark):
    reqs = [_req(1, "ok text", tokens=["ok"]), _req(2, "long key", tokens=["x"], key="k" * 25),
            _req(3, "long lang", tokens=["y"], detected_language="ara")]
    valid, bad = split_valid(validate(normalize(request_frame(spark, reqs))))
    assert [r.id for r in valid.collect()] == [1]
    reasons = {r.id: list(r.reasons) for r in bad.collect()}
    assert reasons == {2: ["raw_mongo_id longer than 24 characters"], 3: ["detected_language longer than 2 characters"]}
