"""Shared plan fragments used by the registered queries and the batch job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.operators.validate import normalize, validate
from spindle.sources.backlog import eligible, ensure_status
from spindle.sources.fixtures import doc_feed


def ts_text(c: Column | str) -> Column:
    """Timestamp as 'yyyy-MM-dd HH:mm:ss' text (UTC session), for time-zone-free comparisons."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def size_or_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.size(c))


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6)


def validated_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible source rows, normalised and validated (reasons + is_valid)."""
    return validate(normalize(eligible(ensure_status(doc_feed(spark, sf_dir)))))


def valid_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated_backlog(spark, sf_dir).where(F.col("is_valid"))


def fixture_models(spark: SparkSession, sf_dir: str, labels: list[str] | None = None, with_topics: bool = True):
    """Side tables derived from the given tables, standing in for the model artefacts."""
    from spindle.config import DEFAULT_LABELS
    from spindle.operators.enrich import Models
    from spindle.operators.topics import topic_catalog, weighted_terms
    from spindle.sources import fixtures as fx

    labels = labels or DEFAULT_LABELS
    if not with_topics:
        return Models(fx.label_lexicon(spark, sf_dir, size=500).cache(), None, None, labels, lexicon_rows_bound=500)
    counts = fx.lang_term_counts(spark, sf_dir)
    lex = fx.label_lexicon(spark, sf_dir, size=500, terms=counts.groupBy("term").agg(F.sum("n").alias("n"))).cache()
    terms = weighted_terms(fx.lang_topic_counts(spark, sf_dir, counts), top=10).cache()
    cat = topic_catalog(terms, fx.topic_info(spark))
    return Models(lex, terms, cat, labels, lexicon_rows_bound=500)


def enriched_backlog(spark: SparkSession, sf_dir: str, with_topics: bool = True) -> DataFrame:
    from spindle.operators.enrich import enrich

    return enrich(validated_backlog(spark, sf_dir), fixture_models(spark, sf_dir, with_topics=with_topics), valid_col="is_valid")
