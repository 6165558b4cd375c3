"""Stop words by language: a document's phrases are its own."""

from pyspark.sql import functions as F

from spindle.operators import keyphrases as kp
from spindle.sources.tables import read_table

from .conftest import SF_SMALL


def _phrases(spark, docs, **lists):
    cands = kp.keyphrase_candidates(docs, "doc_id", "text", "lang", kp.language_stopwords(spark, **lists))
    return {tuple(r) for r in kp.dedup_keyphrases(cands, "doc_id").collect()}


def test_other_documents_change_no_phrase(spark):
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text", "lang")
    few = docs.where("doc_id < 40")
    crowd = spark.range(200).select((F.col("id") + 10**6).alias("doc_id"), F.lit("Budget report of the budget office. " * 3).alias("text"), F.lit("en").alias("lang"))
    want = _phrases(spark, few)
    assert want and want == {p for p in _phrases(spark, few.unionByName(crowd)) if p[0] < 10**6}
    # the corpus's own list does change with them
    first = kp.corpus_stopwords(few, "text", "lang").where("term = 'budget'").count()
    assert first == 0 and kp.corpus_stopwords(few.unionByName(crowd), "text", "lang").where("term = 'budget'").count() == 1


def test_lists(spark):
    extra = spark.createDataFrame([("pl", "Nie"), ("pl", None), ("en", "acme"), (None, "x")], "lang string, term string")
    rows = kp.language_stopwords(spark, extra).collect()
    words = {(r["lang"], r["term"]) for r in rows}
    assert len(rows) == len(words)
    assert {("en", "the"), ("de", "und"), ("fr", "avec"), ("es", "porque"), ("ru", "и"), ("pl", "nie"), ("en", "acme")} <= words
    assert {("en", "don"), ("en", "t")} <= words and not any("'" in t for _, t in words)
    assert {r["lang"] for r in kp.language_stopwords(spark, languages=["de"]).collect()} == {"de"}


def test_language_decides(spark):
    text = "Die Kosten der Klinik. The costs of the clinic."
    docs = spark.createDataFrame([(1, text, "de"), (2, text, "en"), (3, text, "pl"), (4, text, None), (5, None, "en"), (6, "", "en")], "doc_id int, text string, lang string")
    got = {}
    for d, _, phrase, _ in _phrases(spark, docs):
        got.setdefault(d, set()).add(phrase)
    assert set(got) == {1, 2, 3, 4}
    assert "die" not in got[1] and "the" in got[1] and "the" not in got[2] and "die" in got[2]
    assert got[4] == got[2]  # no code of two letters: English
    assert {p[2] for p in _phrases(spark, docs.where("doc_id = 3"), extra=spark.createDataFrame([("pl", "die"), ("pl", "the")], "lang string, term string"))}.isdisjoint({"die", "the"})
