"""Statistical keyphrase extraction (unsupervised, single-document features) as a DataFrame job.

Per document: sentences -> words -> per-term features -> term score S -> 1..3-gram candidates
with no stop word at either end -> candidate score (lower is better) -> top N, then a greedy
de-duplication by string similarity. Features follow the published method (Campos et al.,
2020): casing, position, frequency, relatedness to context, spread over sentences.

Every step is keyed by the document, whose words are dealt out once; term and document statistics
are windows over these words, candidates a hash aggregation in the same part. Stop words come from a (language, term) table that is broadcast after its size is
checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.functions.ranking import inline_indexed
from spindle.functions.text import keyword_language, word_tokens
from spindle.operators.sizing import sized_broadcast

SENTENCE_SPLIT = r"[.!?\n]+"
WORD = r"\p{L}+"
PART_BYTES = 4 << 20  # of text in a part; its words, with their statistics, take about thirty times as much

# languages that Spark ships stop words for, by the code a document carries
STOPWORD_LANGUAGES = {
    "da": "danish", "de": "german", "en": "english", "es": "spanish", "fi": "finnish", "fr": "french", "hu": "hungarian",
    "it": "italian", "nl": "dutch", "no": "norwegian", "pt": "portuguese", "ru": "russian", "sv": "swedish", "tr": "turkish",
}


def language_stopwords(spark: SparkSession, extra: DataFrame | None = None, languages: list[str] | None = None) -> DataFrame:
    """(lang, term): the stop words that Spark ships for each language, and the user's ``extra``
    (lang, term), which may name any other language.

    The list is a fixed few thousand rows, whatever the corpus: a document's phrases don't
    depend on the other documents. Entries are taken apart as texts are (lower case, letter runs), so
    "don't" stops "don" and "t". A language in neither list has no stop words.
    """
    from pyspark.ml.feature import StopWordsRemover

    codes = STOPWORD_LANGUAGES if languages is None else {c: STOPWORD_LANGUAGES[c] for c in languages}
    shipped = [(code, w) for code, name in codes.items() for w in StopWordsRemover.loadDefaultStopWords(name)]
    rows = spark.createDataFrame(shipped, "lang string, entry string")
    if extra is not None:
        rows = rows.unionByName(extra.select("lang", F.col("term").alias("entry")))
    return rows.select("lang", F.explode(word_tokens("entry")).alias("term")).distinct()


def corpus_stopwords(docs: DataFrame, text_col: str, lang_col: str, per_lang: int = 50) -> DataFrame:
    """(lang, term): the ``per_lang`` most frequent terms of each language (count desc, term asc).

    A corpus-derived stop list for languages without a fixed one (:func:`language_stopwords`).
    """
    toks = docs.select(keyword_language(F.col(lang_col)).alias("lang"), F.explode(word_tokens(F.col(text_col))).alias("term"))
    counts = toks.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("term").asc())
    return counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_lang).select("lang", "term")


def text_parts(docs: DataFrame, text_col: str) -> int:
    """Parts of ``PART_BYTES`` of text each, at least as many as the session's shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))


def _sentences(docs: DataFrame, key: str, text_col: str, lang_col: str, *keep: str) -> DataFrame:
    s = docs.select(
        key, *keep, keyword_language(F.col(lang_col)).alias("lang"), F.posexplode(F.split(F.col(text_col), SENTENCE_SPLIT)).alias("s_idx", "sentence")
    )
    s = s.select(key, *keep, "lang", "s_idx", F.regexp_extract_all("sentence", F.lit(WORD), 0).alias("words"))
    return s.where(F.size("words") > 0)


def keyphrase_candidates(
    docs: DataFrame,
    key: str,
    text_col: str,
    lang_col: str,
    stopwords: DataFrame,
    max_n: int = 3,
) -> DataFrame:
    """(key, phrase, n, tf, score) for every candidate of every document; lower score = better.

    The texts cross the network once, dealt out by the document's key into as many parts as hold
    ``PART_BYTES`` of text each; all that follows is keyed by the document, stays in its part and fits
    in a task's memory. Statistics are attached to the words by windows, not joined to them.
    """
    stops, _ = sized_broadcast(stopwords.select("lang", "term").distinct(), 1_000_000)
    texts = docs.select(key, text_col, lang_col).where(F.col(key).isNotNull())
    texts = texts.repartition(text_parts(texts, text_col), key).withColumn("_d", F.monotonically_increasing_id())
    sents = _sentences(texts, key, text_col, lang_col, "_d")

    # words with their neighbours, built from shifted copies of the sentence's word array
    size = F.size("words")
    left = F.concat(F.array(F.lit(None).cast("string")), F.slice("words", 1, F.greatest(size - 1, F.lit(0))))
    right = F.concat(F.slice("words", 2, F.greatest(size, F.lit(1))), F.array(F.lit(None).cast("string")))
    tok = sents.select(key, "_d", "lang", "s_idx", F.posexplode(F.arrays_zip(F.col("words").alias("w"), left.alias("l"), right.alias("r"))).alias("w_idx", "z"))
    word = F.col("z.w")
    is_upper = (F.length(word) > 1) & word.rlike(r"^\p{Lu}+$")
    tok = tok.select(
        key, "_d", "lang", "s_idx", "w_idx", F.lower(word).alias("term"), F.lower("z.l").alias("left"), F.lower("z.r").alias("right"),
        is_upper.alias("is_upper"), (~is_upper & (F.col("w_idx") > 0) & word.rlike(r"^\p{Lu}")).alias("is_cap"),
    )
    tok = tok.join(stops.withColumn("is_stop", F.lit(True)), ["lang", "term"], "left").withColumn("is_stop", F.coalesce("is_stop", F.lit(False)))

    # one sort by (key, term, lang) serves the three windows: a term, a document, a term of any language
    per_term, per_doc, per_word = Window.partitionBy(key, "term", "lang"), Window.partitionBy(key), Window.partitionBy(key, "term")
    in_term = {
        "tf": F.count(F.lit(1)),
        "tf_cap": F.count_if("is_cap"),
        "tf_upper": F.count_if("is_upper"),
        "med": F.percentile(F.col("s_idx").cast("double"), 0.5),
        "sent_tf": F.size(F.collect_set("s_idx").over(per_term)),
        "dl_n": F.size(F.collect_set("left").over(per_term)),
        "dl_d": F.count("left"),
        "dr_n": F.size(F.collect_set("right").over(per_term)),
        "dr_d": F.count("right"),
    }
    tok = tok.select(
        key, "_d", "lang", "s_idx", "w_idx", "term", "is_stop",
        *[(c if n in ("sent_tf", "dl_n", "dr_n") else c.over(per_term)).alias(n) for n, c in in_term.items()],
        (F.struct("_d", "s_idx", "w_idx") == F.min(F.struct("_d", "s_idx", "w_idx")).over(per_term)).alias("_first"),
    )
    once = F.when(~F.col("is_stop") & F.col("_first"), F.col("tf"))
    tok = tok.select(
        "*", F.avg(once).over(per_doc).alias("mean_tf"), F.stddev_pop(once).over(per_doc).alias("std_tf"), F.max(once).over(per_doc).alias("max_tf"),
        F.count_if(F.col("w_idx") == 0).over(per_doc).alias("n_sent"),
    )
    dl = F.when(F.col("dl_d") > 0, F.col("dl_n") / F.col("dl_d")).otherwise(F.lit(0.0))
    dr = F.when(F.col("dr_d") > 0, F.col("dr_n") / F.col("dr_d")).otherwise(F.lit(0.0))
    rel = 1.0 + (dl + dr) * F.col("tf") / F.col("max_tf")
    pos = F.log(F.log(3.0 + F.col("med")))
    case = F.greatest("tf_cap", "tf_upper") / (1.0 + F.log(F.col("tf")))
    freq = F.col("tf") / (F.col("mean_tf") + F.col("std_tf"))
    sent = F.col("sent_tf") / F.col("n_sent")
    score = F.when(~F.col("is_stop") & F.col("_first"), rel * pos / (case + freq / rel + sent / rel))
    tok = tok.select(key, "_d", "s_idx", "w_idx", "term", "is_stop", score.alias("s"))
    tok = tok.select(
        key, "_d", "s_idx", "w_idx", "term", "is_stop",
        F.coalesce(F.sum("s").over(per_word), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum(F.when(F.col("s").isNotNull(), F.log(F.greatest("s", F.lit(1e-300))))).over(per_word), F.lit(0.0)).alias("log_s"),
    )

    # 1..max_n-grams inside each sentence from a word and those after it; no stop word at either end
    in_sentence = Window.partitionBy(key, "_d", "s_idx").orderBy("w_idx")
    nth = F.struct("term", "is_stop", "s", "log_s")
    gram = [f"_g{i}" for i in range(max_n)]
    cand = tok.select(key, "is_stop", nth.alias(gram[0]), *[F.lead(nth, i).over(in_sentence).alias(gram[i]) for i in range(1, max_n)])
    cand = cand.where(~F.col("is_stop"))

    def phrase(n):
        at = [F.col(g) for g in gram[:n]]
        whole = F.struct(
            F.concat_ws(" ", *[g["term"] for g in at]).alias("phrase"), sum((g["log_s"] for g in at[1:]), at[0]["log_s"]).alias("log_prod"),
            sum((g["s"] for g in at[1:]), at[0]["s"]).alias("sum_s"),
        )
        return F.when(at[-1].isNotNull() & ~at[-1]["is_stop"], whole)

    phrases = F.filter(F.array(*[phrase(n) for n in range(1, max_n + 1)]), lambda x: x.isNotNull())
    # the sums of a phrase are the same wherever it stands in a document
    scored = cand.select(key, F.inline(phrases)).groupBy(key, "phrase").agg(
        F.count(F.lit(1)).alias("tf"), F.first("log_prod").alias("log_prod"), F.first("sum_s").alias("sum_s")
    )
    # words are letter runs, so splitting the phrase on a space gives its terms back
    return scored.select(
        key,
        "phrase",
        F.size(F.split("phrase", " ")).alias("n"),
        "tf",
        (F.exp("log_prod") / (F.col("tf") * (1.0 + F.col("sum_s")))).alias("score"),
    )


def top_candidates(cands: DataFrame, key: str, top: int = 10) -> DataFrame:
    """Best ``top`` candidates per document (score asc, ties by phrase); planned as a
    WindowGroupLimit, so only ``top`` rows per document and task reach the window."""
    w = Window.partitionBy(key).orderBy(F.round("score", 10).asc(), F.col("phrase").asc())
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def dedup_keyphrases(cands: DataFrame, key: str, top: int = 10, limit: float = 0.9) -> DataFrame:
    """Greedy de-duplication: walk the candidates best first, keep one unless a kept phrase is
    more similar than ``limit`` (1 - edit distance / longer length); stop at ``top`` kept.

    The walk is a fold over one document's candidates, all of them (no cap), sorted in the row.
    """
    per_doc = cands.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.round("score", 10).alias("k"), F.col("phrase").alias("p"), F.col("score").alias("s")))).alias("c")
    )
    empty = F.array().cast("array<struct<k:double,p:string,s:double>>")

    def similar(a, b):
        return (1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))) > F.lit(limit)

    def step(acc, c):
        keep = (F.size(acc) < top) & F.forall(acc, lambda k: ~similar(k["p"], c["p"]))
        return F.when(keep, F.concat(acc, F.array(c))).otherwise(acc)

    kept = per_doc.select(key, F.aggregate("c", empty, step).alias("kept"))
    return kept.select(key, inline_indexed("kept", "pos", "e")).select(
        key, (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.p").alias("phrase"), F.col("e.s").alias("score")
    )
