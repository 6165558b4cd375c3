"""Requests as JSON lines: damaged lines, rules, what is stored and what is left unmarked."""

import json
import os
import uuid

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql.classic.dataframe import DataFrame as ClassicFrame

from spindle.plans import requests as rq
from spindle.plans.common import fixture_models
from spindle.sinks import results as rs

from .conftest import SF_SMALL

DAY = "2024-05-01T10:00:00Z"


def _request(key="k1", **other):
    base = {"raw_mongo_id": key, "source": "s", "original_timestamp": DAY, "retrieved_by_keyword": "kw", "keyword_language": "en", "cleaned_text": "some text"}
    return {k: v for k, v in {**base, **other}.items() if v is not ...}


GOOD = [
    _request("plain"),
    _request("with-id", id=7, tokens_processed=["a", "b", "a"]),
    _request("text-id", id="8"),
    _request("blank", cleaned_text="  ", lemmas=[]),
    _request("surplus", unknown={"a": [1]}),
]
REASONS = {
    json.dumps(_request("cut"))[:40]: [rq.DAMAGED],
    "[1, 2]": [rq.DAMAGED],
    json.dumps([_request("in-list")]): [rq.DAMAGED],
    "null": [rq.DAMAGED],
    '"text"': [rq.DAMAGED],
    "no json at all": [rq.DAMAGED],
    json.dumps(_request("time", original_timestamp="yesterday")): [rq.DAMAGED],
    json.dumps(_request("number-list", tokens_processed=[1])): ["tokens_processed must be a list of strings"],
    json.dumps(_request("list-text", lemmas="a")): ["lemmas must be a list of strings"],
    json.dumps(_request("bad-id", id="x1")): ["id must be an integer"],
    json.dumps(_request(..., id=1)): ["raw_mongo_id is required"],
    json.dumps(_request("no-text", cleaned_text=None)): ["cleaned_text is required"],
    json.dumps(_request("k" * 25)): ["raw_mongo_id longer than 24 characters"],
    "{}": [f"{c} is required" for c in ("raw_mongo_id", "source", "original_timestamp", "retrieved_by_keyword", "keyword_language", "cleaned_text")],
}


@pytest.fixture(scope="module")
def models(spark):
    return fixture_models(spark, SF_SMALL)


def _lines(spark, folder, lines):
    path = f"{folder}/lines-{uuid.uuid4().hex}.txt"
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines))
    return rq.request_lines(spark, path)


def test_damaged_lines_and_rules(spark, scratch):
    lines = _lines(spark, scratch, [*map(json.dumps, GOOD), "", "   ", *REASONS])
    got = rq.read_requests(lines).select("line", "reasons", "is_valid", "raw_mongo_id", "id").collect()
    assert len(got) == len(GOOD) + len(REASONS)  # blank lines are none
    assert {r["line"]: r["reasons"] for r in got if not r["is_valid"]} == REASONS
    assert {r["raw_mongo_id"]: r["id"] for r in got if r["is_valid"]} == {"plain": None, "with-id": 7, "text-id": 8, "blank": None, "surplus": None}
    assert all(r["raw_mongo_id"] is None for r in got if r["reasons"] == [rq.DAMAGED])


def test_results_are_stored_and_nothing_is_marked(spark, scratch, models):
    results, rejects = f"{scratch}/results", f"{scratch}/rejects"
    lines = _lines(spark, scratch, [*map(json.dumps, GOOD), *REASONS])
    out = rq.analyse_requests(spark, lines, 1, models, results, rejects)
    assert (out.lines, out.stored, out.rejected) == (len(GOOD) + len(REASONS), len(GOOD), len(REASONS))
    rows = {r["raw_mongo_id"]: r for r in rs.read_results(spark, results).collect()}
    assert set(rows) == {g["raw_mongo_id"] for g in GOOD}
    assert [(k["keyword"], k["frequency"]) for k in rows["with-id"]["extracted_keywords_frequency"]] == [("a", 2), ("b", 1)]
    assert rows["plain"]["source_id"] is None and rows["with-id"]["source_id"] == 7
    bad = rq.read_quarantine(spark, rejects).collect()
    assert {r["line"]: r["reasons"] for r in bad} == REASONS and {r["batch_id"] for r in bad} == {1}
    assert not [f for f in os.listdir(scratch) if "log" in f or "status" in f]

    # a later call replaces its keys and keeps the others; of one key the latest request stays
    again = [_request("plain", source="new", original_timestamp="2024-06-01T00:00:00Z"), _request("plain", source="old")]
    assert rq.analyse_requests(spark, _lines(spark, scratch, map(json.dumps, again)), 2, models, results, rejects).rejected == 0
    rows = {r["raw_mongo_id"]: r["source"] for r in rs.read_results(spark, results).collect()}
    assert rows["plain"] == "new" and len(rows) == len(GOOD)
    # replayed, the first call changes no later row and no quarantine row
    rq.analyse_requests(spark, lines, 1, models, results, rejects)
    assert {r["raw_mongo_id"]: r["source"] for r in rs.read_results(spark, results).collect()} == rows
    assert rq.read_quarantine(spark, rejects).count() == len(REASONS)


def test_only_rejects_and_no_lines(spark, scratch, models):
    results, rejects = f"{scratch}/results", f"{scratch}/rejects"
    out = rq.analyse_requests(spark, _lines(spark, scratch, ["{", ""]), 1, models, results, rejects)
    assert (out.lines, out.stored, out.rejected) == (1, 0, 1) and rs.read_results(spark, results) is None
    out = rq.analyse_requests(spark, _lines(spark, scratch, [""]), 2, models, results, rejects)
    assert (out.lines, out.stored, out.rejected) == (0, 0, 0)


def test_a_request_the_analysis_fails_on_is_quarantined(spark, scratch, models, monkeypatch):
    whole = rq.analyse

    def picky(df, *rest):
        if df.where("raw_mongo_id = 'bad'").count():
            raise RuntimeError("no answer")
        return whole(df, *rest)

    monkeypatch.setattr(rq, "analyse", picky)
    lines = _lines(spark, scratch, [json.dumps(_request(k)) for k in ("a", "bad", "c", "d")])
    out = rq.analyse_requests(spark, lines, 1, models, f"{scratch}/results", f"{scratch}/rejects")
    assert (out.stored, out.rejected) == (3, 1)
    assert [r["reasons"] for r in rq.read_quarantine(spark, f"{scratch}/rejects").collect()] == [[rq.FAILED]]
    assert {r[0] for r in rs.read_results(spark, f"{scratch}/results").select("raw_mongo_id").collect()} == {"a", "c", "d"}


def test_parsed_requests_are_not_written_out(spark, scratch, models, monkeypatch):
    """of the requests only their analysis is checkpointed; lines, texts and token lists are read again."""
    kept = []
    checkpoint = ClassicFrame.checkpoint
    monkeypatch.setattr(ClassicFrame, "checkpoint", lambda self, *a, **k: (kept.append(set(self.columns)), checkpoint(self, *a, **k))[1])
    lines = _lines(spark, scratch, [*map(json.dumps, GOOD), *REASONS])
    out = rq.analyse_requests(spark, lines, 1, models, f"{scratch}/results", f"{scratch}/rejects")
    assert (out.lines, out.stored, out.rejected) == (len(GOOD) + len(REASONS), len(GOOD), len(REASONS))
    assert kept and not any(c & {"line", "tokens", "lemmas", "cleaned_text"} for c in kept)


def test_quarantine_parses_a_line_once(spark, scratch, models, monkeypatch):
    plans = []
    parquet = DataFrameWriter.parquet

    def seen(self, path, *a, **k):
        if "rejects" in path:
            plans.append(self._df._jdf.queryExecution().optimizedPlan().toString())
        return parquet(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    lines = _lines(spark, scratch, [*map(json.dumps, GOOD), *REASONS])
    rq.analyse_requests(spark, lines, 1, models, f"{scratch}/results", f"{scratch}/rejects")
    assert len(plans) == 1 and plans[0].count("from_json(") == 1


def test_request_lines_are_read_compressed(spark, scratch):
    spark.createDataFrame([(json.dumps(g),) for g in GOOD], "value string").write.option("compression", "gzip").text(f"{scratch}/lines")
    assert sorted(r["line"] for r in rq.request_lines(spark, f"{scratch}/lines").collect()) == sorted(map(json.dumps, GOOD))
