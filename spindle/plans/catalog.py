"""Registered queries: one per operator of the inventory, each over the whole given tables.

Every query returns flat scalar columns (arrays exploded, doubles rounded to 6 places, times
as text) so that its result can be compared with the DuckDB oracle in ``oracle.py``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.config import DEFAULT_LABELS
from spindle.functions.jsonlist import parse_string_list
from spindle.functions.text import keyword_language, non_blank
from spindle.functions.topics import topic_probability
from spindle.operators.analysis import enrich_with
from spindle.operators.keywords import flat_keywords, keyword_summary, with_keywords
from spindle.operators.scoring import model_scorer, model_topics, term_topics
from spindle.operators.validate import normalize, validate
from spindle.plans.common import r6, size_or_null, ts_text, valid_backlog, validated_backlog
from spindle.schemas import REQUEST_JSON, SOURCE_COLUMNS
from spindle.session import shared_path
from spindle.sources.backlog import backlog_scan, eligible, ensure_status
from spindle.sources.fixtures import doc_feed

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


# ---------------------------------------------------------------- sources and filters


@register("backlog_scan")
def q_backlog_scan(spark, sf_dir):
    """SRC-1/PRJ-1/FLT-1/SRT-1: one bounded batch of 50, oldest first."""
    rows = backlog_scan(doc_feed(spark, sf_dir), limit=50)
    return rows.select(
        *[ts_text(c).alias(c) if c == "original_timestamp" else F.col(c) for c in SOURCE_COLUMNS]
    )


@register("backlog_status_filter")
def q_backlog_status_filter(spark, sf_dir):
    """FLT-1: every row not in a terminal state, NULL status included."""
    return eligible(doc_feed(spark, sf_dir)).select("id", "nlp_status")


@register("ensure_status")
def q_ensure_status(spark, sf_dir):
    """SNK-4: status pair added to a source without it ('pending', no time); kept when present."""
    feed = doc_feed(spark, sf_dir)
    absent = ensure_status(feed.drop("nlp_status", "nlp_status_timestamp")).select(
        F.lit("absent").alias("variant"), "id", "nlp_status", F.col("nlp_status_timestamp").isNull().cast("int").alias("ts_is_null")
    )
    present = ensure_status(feed).select(
        F.lit("present").alias("variant"), "id", "nlp_status", F.col("nlp_status_timestamp").isNull().cast("int").alias("ts_is_null")
    )
    return absent.unionByName(present)


@register("request_scan")
def q_request_scan(spark, sf_dir):
    """SRC-2: request records as JSON text (lists as JSON arrays) parsed with the fixed schema."""
    feed = normalize(doc_feed(spark, sf_dir))
    as_json = feed.select(
        F.to_json(
            F.struct(
                "id", "raw_mongo_id", "source", "original_timestamp", "retrieved_by_keyword", "keyword_language",
                "keyword_concept_id", "detected_language", "cleaned_text",
                F.col("tokens").alias("tokens_processed"), "lemmas", "original_url",
            )
        ).alias("body")
    )
    req = as_json.select(F.from_json("body", REQUEST_JSON).alias("r")).select("r.*")
    req = normalize(req)
    return req.select(
        "id", "raw_mongo_id", "source", ts_text("original_timestamp").alias("original_timestamp"),
        "retrieved_by_keyword", "keyword_language", "keyword_concept_id", "detected_language",
        F.length("cleaned_text").alias("text_chars"), size_or_null("tokens").alias("n_tokens"),
        size_or_null("lemmas").alias("n_lemmas"), "original_url",
    )


@register("normalize_docs")
def q_normalize_docs(spark, sf_dir):
    """PRJ-2: source rows as request records (key as text, lists parsed, NULLs kept)."""
    n = normalize(doc_feed(spark, sf_dir))
    return n.select(
        "id", "raw_mongo_id", "source", ts_text("original_timestamp").alias("original_timestamp"),
        "retrieved_by_keyword", "keyword_language", "keyword_concept_id", "detected_language",
        F.length("cleaned_text").alias("text_chars"), size_or_null("tokens").alias("n_tokens"), "tokens_state",
        size_or_null("lemmas").alias("n_lemmas"), "lemmas_state", "original_url",
    )


@register("parse_token_lists")
def q_parse_token_lists(spark, sf_dir):
    """SC-1: strict JSON list parsing of both token columns, one row per (id, field)."""
    fields = ("tokens_processed", "lemmas")
    parsed = doc_feed(spark, sf_dir).select("id", *[parse_string_list(F.col(f)).alias(f) for f in fields])
    rows = [
        F.struct(
            F.lit(f).alias("field"), F.col(f)["state"].alias("state"), size_or_null(F.col(f)["value"]).alias("n_items"),
            F.get(F.col(f)["value"], 0).alias("first_item"),
        )
        for f in fields
    ]
    return parsed.select("id", F.inline(F.array(*rows)))


@register("validate_docs")
def q_validate_docs(spark, sf_dir):
    """VAL-1 (+VAL-2): every source row with its reasons; valid rows have none."""
    v = validate(normalize(doc_feed(spark, sf_dir)))
    return v.select(
        "id", F.col("is_valid").cast("int").alias("is_valid"), F.array_join("reasons", "; ").alias("reasons"),
        F.size("reasons").alias("n_reasons"),
    )


@register("validate_lengths")
def q_validate_lengths(spark, sf_dir):
    """VAL-2: target length limits per column as data-quality counts over every row."""
    n = normalize(doc_feed(spark, sf_dir))
    from spindle.config import LENGTH_LIMITS

    parts = [
        n.select(F.lit(c).alias("column_name"), F.lit(lim).alias("max_chars"), F.length(c).alias("len"))
        for c, lim in LENGTH_LIMITS.items()
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("column_name", "max_chars").agg(
        F.count_if(F.col("len") > F.col("max_chars")).alias("n_too_long"),
        F.count_if(F.col("len").isNull()).alias("n_null"),
        F.max("len").alias("max_len"),
    )


@register("blank_text_split")
def q_blank_text_split(spark, sf_dir):
    """FLT-2: Unicode-aware blank test on every text."""
    feed = doc_feed(spark, sf_dir)
    cls = (
        F.when(F.col("cleaned_text").isNull(), F.lit("null"))
        .when(non_blank("cleaned_text"), F.lit("text"))
        .otherwise(F.lit("blank"))
    )
    return feed.select("id", cls.alias("text_class"))


@register("keyword_language_rule")
def q_keyword_language_rule(spark, sf_dir):
    """FLT-4: two-character language codes kept, anything else becomes 'en'."""
    feed = doc_feed(spark, sf_dir)
    return feed.select(
        "id",
        keyword_language("detected_language").alias("detected_rule"),
        keyword_language(F.concat("keyword_language", F.lit("x"))).alias("long_rule"),
        keyword_language("keyword_language").alias("keyword_rule"),
    )


# ---------------------------------------------------------------- keywords


@register("keyword_frequency")
def q_keyword_frequency(spark, sf_dir):
    """AGG-1/WIN-2/SC-3: top-10 frequency keywords of every valid backlog document.

    Invalid rows carry no tokens, so they yield no keyword rows; gating instead of filtering keeps
    the validity test (and the strict parse inside it) from being pushed below the parse."""
    v = validated_backlog(spark, sf_dir)
    gated = v.select(
        "id", F.when(F.col("is_valid"), F.col("tokens")).alias("tokens"), F.when(F.col("is_valid"), F.col("lemmas")).alias("lemmas")
    )
    return flat_keywords(with_keywords(gated, 10))


@register("keyword_summary_text")
def q_keyword_summary_text(spark, sf_dir):
    """AGG-2: the top keywords of a document joined in rank order (NULL without keywords)."""
    kw = with_keywords(valid_backlog(spark, sf_dir), 10)
    return kw.select(
        "id", F.col("keyword_summary").alias("summary"), F.size("keywords").alias("n_keywords"),
        non_blank(F.col("keyword_summary")).cast("int").alias("summary_scored"),
    )


# ---------------------------------------------------------------- label scoring

from spindle.operators.labels import (  # noqa: E402
    char_class_model,
    flat_scores,
    score_labels_lexicon,
    score_labels_model,
    score_labels_prototype,
)
from spindle.sources import fixtures as fx  # noqa: E402
from spindle.sources.tables import read_table  # noqa: E402

CUSTOM_LABELS = ["Concerned", "Angry", "Hopeful", "Neutral"]
LEXICON_SIZE = 500


def _lexicon(spark, sf_dir):
    return fx.label_lexicon(spark, sf_dir, size=LEXICON_SIZE)


def _flat(scored, keys):
    f = flat_scores(scored, keys)
    return f.select(*keys, "rank", "label", r6("score").alias("score"))


@register("label_scores")
def q_label_scores(spark, sf_dir):
    """UDF-1/AGG-5/JN-4: lexicon label scores of every non-blank text, softmax, ranked."""
    feed = doc_feed(spark, sf_dir)
    s = score_labels_lexicon(feed, ["id"], "cleaned_text", _lexicon(spark, sf_dir), DEFAULT_LABELS, lexicon_rows_bound=LEXICON_SIZE)
    return _flat(s, ["id"])


@register("label_ranking")
def q_label_ranking(spark, sf_dir):
    """WIN-1: labels of a text in rank order (score desc, label position on ties)."""
    feed = doc_feed(spark, sf_dir)
    s = score_labels_lexicon(feed, ["id"], "cleaned_text", _lexicon(spark, sf_dir), DEFAULT_LABELS, lexicon_rows_bound=LEXICON_SIZE)
    return s.select(
        "id",
        F.array_join(F.transform("scores", lambda x: x["label"]), ",").alias("ranking"),
        r6(F.col("scores")[0]["score"]).alias("top_score"),
    )


@register("label_scores_custom")
def q_label_scores_custom(spark, sf_dir):
    """UDF-2: a custom label set per call (a label unknown to the lexicon scores 0 logit)."""
    feed = doc_feed(spark, sf_dir)
    s = score_labels_lexicon(feed, ["id"], "cleaned_text", _lexicon(spark, sf_dir), CUSTOM_LABELS, lexicon_rows_bound=LEXICON_SIZE)
    return _flat(s, ["id"])


@register("label_scores_proto")
def q_label_scores_proto(spark, sf_dir):
    """UDF-1 prototype scorer: cosine to per-label mean vectors, softmax (T=0.05), ranked."""
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    s = score_labels_prototype(emb, ["vec_id"], "embedding", fx.label_prototypes(spark, sf_dir), DEFAULT_LABELS, 0.05)
    return _flat(s, ["vec_id"])


@register("label_scores_model")
def q_label_scores_model(spark, sf_dir):
    """UDF-1 model scorer: a user model on Arrow batches (deterministic stand-in model)."""
    feed = doc_feed(spark, sf_dir)
    s = score_labels_model(feed, ["id"], "cleaned_text", char_class_model, DEFAULT_LABELS, model_id="char-class")
    return _flat(s, ["id"])


# ---------------------------------------------------------------- topics

from spindle.operators import topic_model as tm  # noqa: E402
from spindle.operators import topics as tp  # noqa: E402


def _topic_terms(spark, sf_dir):
    return tp.topic_terms(fx.lang_topics(spark, sf_dir), top=10)


def _catalog(spark, sf_dir):
    return tp.topic_catalog(_topic_terms(spark, sf_dir), fx.topic_info(spark))


@register("topic_terms")
def q_topic_terms(spark, sf_dir):
    """AGG-7: class-based TF-IDF, top 10 terms per topic."""
    t = _topic_terms(spark, sf_dir)
    return t.select("topic_id", "term", r6("weight").alias("weight"), "rank")


@register("topic_catalog")
def q_topic_catalog(spark, sf_dir):
    """SRC-3: the topic side tables joined into one catalog (terms + stored names)."""
    c = _catalog(spark, sf_dir)
    return c.select("topic_id", "stored_name", F.size("keywords").alias("n_terms"))


@register("topic_names")
def q_topic_names(spark, sf_dir):
    """SC-5/WIN-5: display name per catalog topic (stored, rebuilt from top 3 terms, or 'Topic n')."""
    from spindle.functions.topics import topic_display_name

    c = _catalog(spark, sf_dir)
    return c.select(
        "topic_id",
        topic_display_name(F.col("topic_id"), F.col("stored_name"), F.transform("keywords", lambda e: e["term"])).alias("name"),
    )


@register("topic_assign_text")
def q_topic_assign_text(spark, sf_dir):
    """UDF-3 text mode: topic of every document from weighted terms, with probability."""
    feed = doc_feed(spark, sf_dir)
    a = tp.assign_topics_text(feed, ["id"], "cleaned_text", _topic_terms(spark, sf_dir))
    return a.select("id", "topic_id", r6("probability").alias("probability"), "blank")


@register("topic_details")
def q_topic_details(spark, sf_dir):
    """JN-3/UDF-4: assigned topic joined to its terms and name (unknown topic: no terms)."""
    feed = doc_feed(spark, sf_dir)
    a = tp.assign_topics_text(feed, ["id"], "cleaned_text", _topic_terms(spark, sf_dir))
    d = tp.with_topic_details(a, _catalog(spark, sf_dir))
    return d.select(
        "id",
        F.col("topic.id").alias("topic_id"),
        F.col("topic.name").alias("topic_name"),
        F.size("topic.keywords").alias("n_terms"),
        F.get(F.col("topic.keywords"), 0)["term"].alias("first_term"),
        r6("topic.probability").alias("probability"),
    )


@register("topic_assign")
def q_topic_assign(spark, sf_dir):
    """UDF-3 vector mode / JN-5 / WIN-4: nearest centroid, outlier below cosine 0.15."""
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    a = tp.assign_topics_vector(emb, ["vec_id"], "embedding", fx.topic_centroids(spark, sf_dir), 0.15, 0.05)
    return a.select("vec_id", "topic_id", r6("probability").alias("probability"), r6("best_cosine").alias("best_cosine"))


@register("topic_probability")
def q_topic_probability(spark, sf_dir):
    """AGG-6/SC-6: max of each document's topic distribution (softmax over all centroids)."""
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    a = tp.assign_topics_vector(emb, ["vec_id"], "embedding", fx.topic_centroids(spark, sf_dir), 0.15, 0.05)
    return a.select("vec_id", r6("probability").alias("max_probability"))


@register("topic_probability_forms")
def q_topic_probability_forms(spark, sf_dir):
    """AGG-6/SC-6: the probability from a number, from a distribution over topics, and from neither."""
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    a = tp.assign_topics_vector(emb, ["vec_id"], "embedding", fx.topic_centroids(spark, sf_dir))
    p, rest = F.col("probability"), 1 - F.col("probability")
    forms = {"number": (p, F.lit(None).cast("array<double>")), "distribution": (F.lit(None).cast("double"), F.array(rest / 2, p, rest / 2)), "none": (F.lit(None).cast("double"), F.lit(None).cast("array<double>"))}
    rows = [F.struct(F.lit(k).alias("form"), r6(topic_probability(x, xs)).alias("probability")) for k, (x, xs) in forms.items()]
    return a.select("vec_id", F.inline(F.array(*rows)))


@register("topic_centroids")
def q_topic_centroids(spark, sf_dir):
    """UDF-7 (guided): centroid of each seed label, one row per dimension."""
    emb = read_table(spark, sf_dir, "embeddings").select("label", "embedding")
    c = tp.seeded_centroids(emb, "embedding", "label")
    from spindle.functions.ranking import inline_indexed

    return c.select("topic_id", inline_indexed("centroid", "dim", "value")).select(
        "topic_id", F.col("dim").cast("int").alias("dim"), r6("value").alias("value")
    )


@register("topic_fit")
def q_topic_fit(spark, sf_dir):
    """UDF-7: k-means topic fitting (k=10) and the assignment of every vector."""
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    cents, model, feats = tp.fit_topics(emb, "embedding", k=10, seed=7)
    return model.transform(feats).select("vec_id", F.col("topic_id").cast("int").alias("topic_id"))


@register("topic_model_roundtrip")
def q_topic_model_roundtrip(spark, sf_dir):
    """UDF-7/SRC-3: a guided model with terms and names from the documents of its vectors, stored under
    a version and loaded; topic and name of every vector, and whether the fitted model gives the same."""
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    fitted = tm.fit_model(tp.seeded_centroids(emb, "embedding", "label"), emb, "vec_id", "embedding", docs, "doc_id", "text")
    root = shared_path(spark, "spindle-models", uuid.uuid4().hex)
    tm.save_model(fitted, root, "v1")
    loaded = tm.load_model(spark, root)
    assigned = tp.with_topic_details(loaded.assign(emb, ["vec_id"], "embedding"), loaded.catalog)
    before = fitted.assign(emb, ["vec_id"], "embedding").select("vec_id", F.col("topic_id").alias("_t"), F.col("probability").alias("_p"))
    t = F.col("topic")
    same = t["id"].eqNullSafe(F.col("_t")) & t["probability"].eqNullSafe(F.col("_p"))
    return assigned.join(before, "vec_id").select(
        "vec_id", t["id"].alias("topic_id"), t["name"].alias("topic_name"), F.size(t["keywords"]).alias("n_terms"),
        r6(F.get(t["keywords"], 0)["weight"]).alias("first_weight"), r6(t["probability"]).alias("probability"), same.cast("int").alias("same"),
    )


# ---------------------------------------------------------------- enrichment and results

from spindle.plans import requests as rq  # noqa: E402
from spindle.operators.enrich import ANALYSED_COLUMNS, Models, enrich  # noqa: E402
from spindle.plans.common import enriched_backlog, fixture_models  # noqa: E402
from spindle.sinks import ledger as lg  # noqa: E402
from spindle.sinks import results as rs  # noqa: E402


def _ranking(c):
    return F.array_join(F.transform(c, lambda x: x["label"]), ",")


@register("enrich_documents")
def q_enrich_documents(spark, sf_dir):
    """UDF-6/PRJ-3: full analysis of every valid backlog document (flagship)."""
    e = enriched_backlog(spark, sf_dir)
    t = F.get(F.col("assigned_topics"), 0)
    return e.select(
        "id", "raw_mongo_id", "source", ts_text("original_timestamp").alias("original_timestamp"),
        "retrieved_by_keyword", "keyword_concept_id", "original_keyword_language", "detected_language",
        _ranking(F.col("overall_sentiment")).alias("sentiment_ranking"),
        r6(F.get(F.col("overall_sentiment"), 0)["score"]).alias("top_score"),
        t["id"].alias("topic_id"), t["name"].alias("topic_name"), r6(t["probability"]).alias("topic_probability"),
        F.size(t["keywords"]).alias("n_topic_terms"),
        F.size("extracted_keywords_frequency").alias("n_keywords"),
        F.array_join(F.transform("extracted_keywords_frequency", lambda k: F.concat(k["keyword"], F.lit(":"), k["frequency"].cast("string"))), " ").alias("keywords_text"),
        _ranking(F.col("sentiment_on_extracted_keywords_summary")).alias("summary_ranking"),
        r6(F.get(F.col("sentiment_on_extracted_keywords_summary"), 0)["score"]).alias("summary_top_score"),
        F.coalesce(F.size("analysis_errors"), F.lit(0)).alias("n_errors"),
    )


def _flat_analysis(e):
    t = F.get(F.col("assigned_topics"), 0)
    summary = F.col("sentiment_on_extracted_keywords_summary")
    return e.select(
        "id", _ranking(F.col("overall_sentiment")).alias("sentiment_ranking"), r6(F.get(F.col("overall_sentiment"), 0)["score"]).alias("top_score"),
        t["id"].alias("topic_id"), t["name"].alias("topic_name"), r6(t["probability"]).alias("topic_probability"),
        F.size("extracted_keywords_frequency").alias("n_keywords"), _ranking(summary).alias("summary_ranking"),
        r6(F.get(summary, 0)["score"]).alias("summary_top_score"), F.coalesce(F.size("analysis_errors"), F.lit(0)).alias("n_errors"),
    )


@register("enrich_with_model")
def q_enrich_with_model(spark, sf_dir):
    """UDF-6 with a plug-in scorer: both texts of every valid document, each distinct text once."""
    m = fixture_models(spark, sf_dir)
    docs = validated_backlog(spark, sf_dir)
    return _flat_analysis(enrich_with(docs, model_scorer(char_class_model, "char-class"), term_topics(m.topic_terms), m.catalog, valid_col="is_valid"))


def _picky_scorer():
    """Fails on texts whose length leaves 3 when divided by 7, and with them on any batch that holds one."""
    model = char_class_model()

    def predict(texts, labels):
        if any(len(t) % 7 == 3 for t in texts):
            raise ValueError("a text this model can't read")
        return model(texts, labels)

    return predict


def _picky_topics():
    """No result where the length leaves 2 when divided by 5; else a topic with a number, a
    distribution or nothing as its probability."""

    def predict(texts):
        forms = [lambda n: 0.5, lambda n: [0.25, n % 4 / 4.0], lambda n: None]
        return [None if len(t) % 5 == 2 else (len(t) % 4, forms[len(t) % 3](len(t))) for t in texts]

    return predict


@register("request_enrich")
def q_request_enrich(spark, sf_dir):
    """SRC-2 on request: every document as a line of JSON, some damaged, of another form, without a key
    or an id; the results as stored and the rejects as quarantined."""
    feed = normalize(doc_feed(spark, sf_dir)).withColumn("_d", F.col("id"))
    at = lambda n, r: F.col("_d") % n == r
    fields = F.struct(
        F.when(at(43, 10), F.concat(F.lit("x"), F.col("id").cast("string"))).when(~at(5, 0), F.col("id").cast("string")).alias("id"),
        F.when(~at(41, 9), F.col("raw_mongo_id")).alias("raw_mongo_id"),
        "source", "original_timestamp", "retrieved_by_keyword", "keyword_language", "keyword_concept_id", "detected_language", "cleaned_text",
        F.when(at(37, 8), F.array(F.lit(1).cast("variant"))).otherwise(F.transform("tokens", lambda x: x.cast("variant"))).alias("tokens_processed"),
        "lemmas", "original_url",
    )
    body = F.to_json(fields)
    line = F.when(at(29, 4), F.substring(body, 1, 60)).when(at(31, 6), F.concat(F.lit("["), F.col("_d").cast("string"), F.lit("]"))).otherwise(body)
    path = shared_path(spark, "spindle-requests", uuid.uuid4().hex)
    feed.select(line.alias("value")).write.option("compression", "gzip").text(f"{path}/lines")
    rq.analyse_requests(spark, rq.request_lines(spark, f"{path}/lines"), 1, fixture_models(spark, sf_dir), f"{path}/results", f"{path}/rejects")
    stored = rs.read_results(spark, f"{path}/results")
    none = F.lit(None).cast("string")
    good = stored.select(
        F.lit("stored").alias("outcome"), "raw_mongo_id", "source_id", none.alias("reasons"),
        F.size("extracted_keywords_frequency").alias("n_keywords"), F.get("assigned_topics", 0)["id"].alias("topic_id"), F.lit(1).cast("long").alias("n_lines"),
    )
    bad = rq.read_quarantine(spark, f"{path}/rejects").groupBy(F.array_join("reasons", "; ").alias("reasons")).agg(F.count(F.lit(1)).alias("n_lines"))
    bad = bad.select(
        F.lit("rejected").alias("outcome"), none.alias("raw_mongo_id"), F.lit(None).cast("long").alias("source_id"), "reasons",
        F.lit(None).cast("int").alias("n_keywords"), F.lit(None).cast("int").alias("topic_id"), "n_lines",
    )
    return good.unionByName(bad)


@register("analysis_errors")
def q_analysis_errors(spark, sf_dir):
    """AGG-8: per-document error list: all models, no topic model, plug-ins that fail on some
    texts, and neither a scorer nor the topic model's encoder."""
    m = fixture_models(spark, sf_dir)
    # parsed and validated once for the four variants
    docs = validated_backlog(spark, sf_dir).select(*ANALYSED_COLUMNS, "is_valid").checkpoint(eager=True).where("is_valid")
    variants = {
        "full": enrich(docs, m),
        "no_topic_model": enrich(docs, Models(m.lexicon, None, None, m.labels, m.lexicon_rows_bound)),
        "failing_texts": enrich_with(docs, model_scorer(_picky_scorer, "picky"), model_topics(_picky_topics, "picky-topics"), m.catalog),
        "nothing_loaded": enrich_with(docs, None, None, m.catalog),
    }
    parts = [e.select(F.lit(v).alias("variant"), "id", "analysis_errors", F.get(F.col("assigned_topics"), 0)["probability"].alias("p")) for v, e in variants.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(
        "variant", "id", F.coalesce(F.size("analysis_errors"), F.lit(0)).alias("n_errors"),
        F.array_join("analysis_errors", " | ").alias("errors"), F.when(F.col("variant") == "failing_texts", r6("p")).alias("topic_probability"),
    )


@register("export_rows")
def q_export_rows(spark, sf_dir):
    """PRJ-4/SC-2: result rows in the relational export form (JSON text, empty lists NULL)."""
    rows = rs.result_rows(enriched_backlog(spark, sf_dir), batch_id=1)
    ex = rs.export_rows(rs.upsert(None, rows))
    return ex.select(
        "raw_mongo_id", "nlp_model_version", "signal_extraction_status",
        F.length("overall_sentiment").alias("sentiment_json_chars"),
        F.length("assigned_topics").alias("topics_json_chars"),
        F.col("extracted_keywords_frequency").alias("keywords_json"),
        F.col("analysis_errors").isNull().cast("int").alias("errors_null"),
    )


@register("dedupe_latest")
def q_dedupe_latest(spark, sf_dir):
    """WIN-3: last write wins per business key (oldest first, NULL times last, then id)."""
    v = valid_backlog(spark, sf_dir).select("raw_mongo_id", "id", "original_timestamp")
    d = rs.latest_per_key(v)
    return d.select("raw_mongo_id", "id", ts_text("original_timestamp").alias("original_timestamp"))


def _results_fixture(spark, sf_dir, enriched=None):
    """Result table after a first pass over the valid backlog, then a downstream consumer that
    marked the rows it already handled (original time before February 2024)."""
    enriched = enriched if enriched is not None else enriched_backlog(spark, sf_dir)
    rows = rs.result_rows(enriched, batch_id=1)
    table = rs.upsert(None, rows)
    handled = F.col("original_timestamp") < F.lit("2024-02-01 00:00:00").cast("timestamp")
    return table.withColumn(
        "signal_extraction_status", F.when(handled, F.lit("extracted")).otherwise(F.col("signal_extraction_status"))
    )


@register("upsert_results")
def q_upsert_results(spark, sf_dir):
    """SNK-1/JN-1: second pass re-sends the rows awaiting store verification; they replace
    their keys (downstream status reset to pending), every other key is kept."""
    # both passes and the keys of the second read the enrichment: it is computed once
    enriched = enriched_backlog(spark, sf_dir).checkpoint(eager=True)
    old = _results_fixture(spark, sf_dir, enriched)
    # the re-sent rows: results of the source rows still awaiting store verification
    resend_ids = doc_feed(spark, sf_dir).where(F.col("nlp_status") == "pending_nlp_store_verification").select("id")
    new = rs.result_rows(enriched.join(resend_ids, "id", "left_semi"), batch_id=2)
    merged = rs.upsert(old, new)
    return merged.select(
        "raw_mongo_id", "source_id", "batch_id", "signal_extraction_status",
        F.size("extracted_keywords_frequency").alias("n_keywords"),
    )


# ------------------------------------------------------------ status ledger (two passes)

from spindle.config import STATUS_FAILED, STATUS_STORE_UNVERIFIED  # noqa: E402

FAILED_STORE_BATCH = 2  # the batch whose result store fails in the first pass


def _pass1(spark, sf_dir):
    """First pass over the whole backlog in daily batches (batch = day of the original time,
    NULL times in the last batch); the store of batch 2 fails."""
    v = validated_backlog(spark, sf_dir)
    day = F.floor((F.unix_timestamp("original_timestamp") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 86400)
    batch = F.coalesce(day + 1, F.lit(1000)).cast("long")
    v = v.withColumn("batch_id", batch)
    status = lg.outcome_status(F.col("is_valid"), F.col("batch_id") != FAILED_STORE_BATCH)
    ts = F.lit("2024-06-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("batch_id").cast("int"))
    return lg.status_entries(v, status, ts, F.col("batch_id"))


def _pass2(spark, sf_dir, log1):
    """Retry pass: rows still eligible after the first pass, all stored."""
    src = lg.with_current_status(doc_feed(spark, sf_dir), log1)
    retry = validate(normalize(eligible(src)))
    status = lg.outcome_status(F.col("is_valid"), F.lit(True))
    ts = F.lit("2024-07-01 00:00:00").cast("timestamp")
    return lg.status_entries(retry, status, ts, 2000)


@register("outcome_status")
def q_outcome_status(spark, sf_dir):
    """JN-2/STR-5: status of every processed row from its validation and its batch's store."""
    return _pass1(spark, sf_dir).select("id", "nlp_status", "batch_id")


@register("outcome_counts")
def q_outcome_counts(spark, sf_dir):
    """AGG-3: evaluated / succeeded / failed per batch of the first pass."""
    return _pass1(spark, sf_dir).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.count_if(F.col("nlp_status") != STATUS_FAILED).alias("succeeded"),
        F.count_if(F.col("nlp_status") == STATUS_FAILED).alias("failed"),
        F.count_if(F.col("nlp_status") == STATUS_STORE_UNVERIFIED).alias("store_unverified"),
    )


@register("status_update")
def q_status_update(spark, sf_dir):
    """SNK-2/FLT-3: ids marked per (batch, status), restricted to ids present in the source."""
    entries = lg.mark(_pass1(spark, sf_dir), doc_feed(spark, sf_dir).select("id"))
    return entries.groupBy("batch_id", "nlp_status").agg(F.count(F.lit(1)).alias("updated"))


@register("backlog_with_log")
def q_backlog_with_log(spark, sf_dir):
    """JN-6: source rows with the latest logged status after the first pass."""
    cur = lg.with_current_status(doc_feed(spark, sf_dir), _pass1(spark, sf_dir))
    return cur.select("id", "nlp_status", ts_text("nlp_status_timestamp").alias("nlp_status_timestamp"))


@register("retry_backlog")
def q_retry_backlog(spark, sf_dir):
    """STR-4: what is still eligible after the first pass (store-unverified and untouched rows)."""
    cur = lg.with_current_status(doc_feed(spark, sf_dir), _pass1(spark, sf_dir))
    return eligible(cur).select("id", "nlp_status")


@register("latest_status")
def q_latest_status(spark, sf_dir):
    """AGG-4: latest status per id over both passes of the ledger."""
    log1 = _pass1(spark, sf_dir)
    log = log1.unionByName(_pass2(spark, sf_dir, log1))
    last = lg.latest_status(log)
    return last.select("id", "nlp_status", "batch_id", ts_text("nlp_status_timestamp").alias("nlp_status_timestamp"))


# ---------------------------------------------------------------- access paths


@register("results_by_topic")
def q_results_by_topic(spark, sf_dir):
    """ACC-1: results that contain topic 1."""
    t = _results_fixture(spark, sf_dir)
    hit = t.where(F.exists("assigned_topics", lambda x: x["id"] == 1))
    return hit.select("raw_mongo_id", r6(F.get(F.col("assigned_topics"), 0)["probability"]).alias("probability"))


@register("signal_queue")
def q_signal_queue(spark, sf_dir):
    """ACC-2: the downstream queue, every result still 'pending' with its time."""
    t = _results_fixture(spark, sf_dir).where(F.col("signal_extraction_status") == "pending")
    return t.select("raw_mongo_id", ts_text("original_timestamp").alias("original_timestamp"))


@register("results_by_time")
def q_results_by_time(spark, sf_dir):
    """ACC-3: results with an original time in [2024-01-10, 2024-01-20)."""
    t = _results_fixture(spark, sf_dir)
    lo, hi = F.lit("2024-01-10 00:00:00").cast("timestamp"), F.lit("2024-01-20 00:00:00").cast("timestamp")
    r = t.where((F.col("original_timestamp") >= lo) & (F.col("original_timestamp") < hi))
    return r.select("raw_mongo_id", ts_text("original_timestamp").alias("original_timestamp"), "source")


@register("results_by_concept")
def q_results_by_concept(spark, sf_dir):
    """ACC-4: results of one keyword concept, and one business key."""
    t = _results_fixture(spark, sf_dir)
    concept = "c" * 23 + "5"
    r = t.where((F.col("keyword_concept_id") == concept) | (F.col("raw_mongo_id") == F.lpad(F.lit("42"), 24, "0")))
    return r.select("raw_mongo_id", "keyword_concept_id", "retrieved_by_keyword")


# ---------------------------------------------------------------- streaming

_STREAM_RUNS: dict[tuple[str, str], str] = {}


def _stream_run(spark, sf_dir):
    """Source rows written as JSON-lines files (50 rows each, a key never split over files),
    drained by the enrichment stream with availableNow; returns the run folder."""
    import uuid

    from spindle.config import EngineConfig
    from spindle.session import shared_path
    from spindle.streaming import stream

    k = (spark.sparkContext.applicationId, sf_dir)
    if k in _STREAM_RUNS:
        return _STREAM_RUNS[k]
    root = shared_path(spark, "spindle-runs", uuid.uuid4().hex)
    stream.write_feed_files(doc_feed(spark, sf_dir), f"{root}/in", rows_per_file=50)
    models = fixture_models(spark, sf_dir)
    # files of 50 rows, five files per micro-batch
    q = stream.start(spark, f"{root}/in", models, f"{root}/results", f"{root}/log", f"{root}/ckpt", EngineConfig(),
                     available_now=True, max_files_per_trigger=5)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    _STREAM_RUNS[k] = root
    return root


@register("stream_enrich")
def q_stream_enrich(spark, sf_dir):
    """STR-1/2/3: the result table after the stream drained every source file."""
    root = _stream_run(spark, sf_dir)
    t = rs.read_results(spark, f"{root}/results")
    return t.select(
        "raw_mongo_id", "source_id", "signal_extraction_status",
        F.size("extracted_keywords_frequency").alias("n_keywords"),
        F.get(F.col("assigned_topics"), 0)["id"].alias("topic_id"),
    )


@register("stream_status")
def q_stream_status(spark, sf_dir):
    """STR-5 in the stream: latest logged status of every source row the stream processed."""
    root = _stream_run(spark, sf_dir)
    log = lg.read_log(spark, f"{root}/log")
    return lg.latest_status(log).select("id", "nlp_status")


# ---------------------------------------------------------------- keyphrases

from spindle.operators import keyphrases as kp  # noqa: E402


def _keyphrase_candidates(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    stops = kp.corpus_stopwords(docs, "text", "lang", per_lang=50)
    return kp.keyphrase_candidates(docs, "doc_id", "text", "lang", stops, max_n=3)


@register("keyphrase_scores")
def q_keyphrase_scores(spark, sf_dir):
    """UDF-5 (before de-duplication): the 10 best-scored 1..3-gram candidates of every document."""
    top = kp.top_candidates(_keyphrase_candidates(spark, sf_dir), "doc_id", top=10)
    return top.select("doc_id", F.col("rank").cast("int").alias("rank"), "phrase", "n", "tf", r6("score").alias("score"))


@register("keyphrases")
def q_keyphrases(spark, sf_dir):
    """UDF-5: top 10 keyphrases per document after greedy de-duplication (similarity > 0.9)."""
    k = kp.dedup_keyphrases(_keyphrase_candidates(spark, sf_dir), "doc_id", top=10, limit=0.9)
    return k.select("doc_id", "rank", "phrase", r6("score").alias("score"))


def _language_candidates(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return kp.keyphrase_candidates(docs, "doc_id", "text", "lang", kp.language_stopwords(spark), max_n=3)


@register("keyphrase_scores_language")
def q_keyphrase_scores_language(spark, sf_dir):
    """UDF-5 with the stop words of each document's language, before de-duplication."""
    top = kp.top_candidates(_language_candidates(spark, sf_dir), "doc_id", top=10)
    return top.select("doc_id", F.col("rank").cast("int").alias("rank"), "phrase", "n", "tf", r6("score").alias("score"))


@register("keyphrases_language")
def q_keyphrases_language(spark, sf_dir):
    """UDF-5: top 10 keyphrases per document by the stop words of its language, after de-duplication."""
    k = kp.dedup_keyphrases(_language_candidates(spark, sf_dir), "doc_id", top=10, limit=0.9)
    return k.select("doc_id", "rank", "phrase", r6("score").alias("score"))
