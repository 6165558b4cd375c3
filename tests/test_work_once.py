"""F8 to F11: the shared steps of the enrichment run once, whatever reads their rows."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.operators import topics as tp
from spindle.operators.analysis import enrich_with
from spindle.operators.scoring import model_scorer, model_topics
from spindle.plans import common
from spindle.plans.catalog import REGISTRY

from .conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_upsert_reads_the_enrichment_once(spark):
    plan = _plan(REGISTRY["upsert_results"](spark, SF_SMALL))
    assert "ArrowEvalPython" not in plan and "text:string" not in plan


@pytest.mark.parametrize("query", ["enrich_with_model", "analysis_errors"])
def test_token_lists_are_parsed_before_the_variants(spark, query):
    assert "text:string" not in _plan(REGISTRY[query](spark, SF_SMALL))


def test_topic_terms_read_the_texts_once(spark):
    docs = spark.createDataFrame([(1, "haus am see haus"), (1, "das boot"), (2, "casa blanca casa"), (None, "x")], "topic_id int, text string")
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(t):
        read.add(1)
        return t

    terms = tp.topic_terms(docs.withColumn("text", seen.asNondeterministic()("text")), top=2).collect()
    assert read.value == 4
    assert {(r.topic_id, r.term) for r in terms if r.rank == 1} == {(1, "haus"), (2, "casa")}


def test_invalid_rows_are_dropped_after_the_checkpoint(spark):
    v = common.validated_backlog(spark, SF_SMALL).where("id < 60")
    scorer = model_scorer(lambda: lambda texts, labels: [[1.0 / len(labels)] * len(labels) for _ in texts], "even")
    topics = model_topics(lambda: lambda texts: [(len(t) % 4, 0.5) for t in texts], "lengths")
    cat = spark.createDataFrame([(0, "a", [])], "topic_id int, stored_name string, keywords array<struct<term:string,weight:double>>")
    assert v.where(~F.col("is_valid")).count() > 0

    def rows(df: DataFrame):
        return sorted(map(str, df.drop("processing_timestamp").collect()))

    assert rows(enrich_with(v, scorer, topics, cat, valid_col="is_valid")) == rows(enrich_with(v.where("is_valid"), scorer, topics, cat))


def test_side_tables_of_one_count(spark):
    from spindle.operators.topics import topic_terms
    from spindle.sources import fixtures as fx

    m = common.fixture_models(spark, SF_SMALL)
    lex = {(r.term, r.label, round(r.weight, 9)) for r in fx.label_lexicon(spark, SF_SMALL).collect()}
    assert {(r.term, r.label, round(r.weight, 9)) for r in m.lexicon.collect()} == lex
    terms = {(r.topic_id, r.term, r.rank, round(r.weight, 9)) for r in topic_terms(fx.lang_topics(spark, SF_SMALL)).collect()}
    assert {(r.topic_id, r.term, r.rank, round(r.weight, 9)) for r in m.topic_terms.collect()} == terms
    assert "text:string" not in _plan(m.lexicon) + _plan(m.topic_terms) + _plan(fx.lang_term_counts(spark, SF_SMALL))
