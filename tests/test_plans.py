"""Physical-plan shape of the headline queries: the scale properties the design relies on."""

from collections import Counter

import pytest

from spindle.plans.catalog import REGISTRY

from .conftest import SF_SMALL


def _nodes(df):
    """Node names of the physical plan before adaptive re-planning (cached subplans not entered)."""
    names = []

    def walk(n):
        nm = n.nodeName()
        if nm == "AdaptiveSparkPlan":
            return walk(n.initialPlan())
        names.append(nm)
        if nm == "InMemoryTableScan":
            return
        it = n.children().iterator()
        while it.hasNext():
            walk(it.next())

    walk(df._jdf.queryExecution().executedPlan())
    return Counter(names)


class _Planned:
    """A query planned right after it is built (later caches of equal subplans cannot replace it)."""

    def __init__(self, df):
        self.nodes = _nodes(df)
        self.text = df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    keys = ["backlog_scan", "keyword_frequency", "label_scores", "topic_terms", "enrich_documents", "dedupe_latest"]
    out = {}
    for k in keys:
        spark.catalog.clearCache()
        out[k] = _Planned(REGISTRY[k](spark, SF_SMALL))
    return out


def test_backlog_scan_is_topk_with_pushed_status_filter(plans):
    p = plans["backlog_scan"]
    assert p.nodes["TakeOrderedAndProject"] == 1
    assert "PushedFilters" in p.text


def test_keyword_frequency_needs_no_shuffle(plans):
    n = plans["keyword_frequency"].nodes
    assert n["Exchange"] == 0 and n["Window"] == 0


def test_label_scoring_broadcasts_the_lexicon(plans):
    n = plans["label_scores"].nodes
    assert n["BroadcastHashJoin"] >= 1 and n["SortMergeJoin"] == 0


def test_topic_terms_topk_is_a_group_limit(plans):
    assert plans["topic_terms"].nodes["WindowGroupLimit"] >= 1


def test_enrichment_has_one_shuffle(plans):
    n = plans["enrich_documents"].nodes
    assert n["Exchange"] == 1
    assert n["SortMergeJoin"] == 0 and n["BroadcastNestedLoopJoin"] == 0 and n["CartesianProduct"] == 0


def test_last_write_wins_is_an_aggregation_not_a_window(plans):
    n = plans["dedupe_latest"].nodes
    assert n["Window"] == 0 and n["Exchange"] == 1
