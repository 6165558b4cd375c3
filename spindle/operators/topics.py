"""Topics: term weights, catalog (names + terms), assignment by text or by vector, fitting.

The topic model artefact of the reference is opaque; here it is three side tables
(centroids, weighted terms, stored names), all bounded by the number of topics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.functions.once import once
from spindle.functions.text import non_blank, word_tokens
from spindle.functions.topics import topic_display_name
from spindle.functions.vectors import as_double_array, dot, unit
from spindle.operators.sizing import require_rows, sized_broadcast

OUTLIER = -1
BLOCK_TOPICS = 2_000  # centroids in one row
PASS_BLOCKS = 20  # blocks broadcast in one pass over the vectors


def topic_terms(labelled: DataFrame, top: int = 10, text_col: str = "text", topic_col: str = "topic_id") -> DataFrame:
    """Class-based TF-IDF term weights per topic, top ``top`` terms each.

    weight(t, c) = tf(t, c) / n(c) * ln(1 + A / f(t)), with n(c) the tokens of topic c, f(t) the
    frequency of t over all topics and A the mean tokens per topic.

    Plan: tokens are counted per (topic, term) with map-side partial aggregation and the counts
    checkpointed, so the texts are read once; the per-topic totals (one row per topic) are broadcast,
    the per-term totals are a shuffle join on term.
    The top-k filter over ``row_number`` becomes a WindowGroupLimit below the window's shuffle,
    so a topic holding most of the corpus sends only ``top`` rows per task, not its vocabulary.
    """
    toks = labelled.select(F.col(topic_col).alias("topic_id"), F.explode(word_tokens(F.col(text_col))).alias("term"))
    return weighted_terms(toks.groupBy("topic_id", "term").agg(F.count(F.lit(1)).alias("tf")).checkpoint(eager=True), top)


def weighted_terms(tf: DataFrame, top: int = 10) -> DataFrame:
    """``topic_terms`` of counts (topic_id, term, tf), which are read several times."""
    n_topic = tf.groupBy("topic_id").agg(F.sum("tf").alias("n_topic"))
    n_topic_b, _ = sized_broadcast(n_topic)
    avg_tokens = n_topic.agg(F.avg("n_topic").alias("a"))
    f_term = tf.groupBy("term").agg(F.sum("tf").alias("f_term"))
    w = (
        tf.join(n_topic_b, "topic_id")
        .join(f_term, "term")
        .crossJoin(F.broadcast(avg_tokens))
        .select(
            "topic_id",
            "term",
            (F.col("tf") / F.col("n_topic") * F.log(1.0 + F.col("a") / F.col("f_term"))).alias("weight"),
        )
    )
    order = Window.partitionBy("topic_id").orderBy(F.round("weight", 10).desc(), F.col("term").asc())
    ranked = w.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("topic_id").cast("int"), "term", "weight", F.col("rank").cast("int"))


def topic_catalog(terms: DataFrame, names: DataFrame) -> DataFrame:
    """(topic_id, name, keywords ARRAY<STRUCT<term, weight>>) for every topic with terms or a name.

    Fails fast when the catalog is empty (the reference refuses to start without its model).
    """
    per_topic = terms.groupBy("topic_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "term", "weight"))),
            lambda e: F.struct(e["term"].alias("term"), e["weight"].alias("weight")),
        ).alias("keywords")
    )
    cat = per_topic.join(names.select("topic_id", F.col("name").alias("stored_name")), "topic_id", "full_outer")
    cat = cat.select(
        "topic_id",
        "stored_name",
        F.coalesce("keywords", F.array().cast("array<struct<term:string,weight:double>>")).alias("keywords"),
    ).cache()
    require_rows(cat, "topic catalog")
    return cat


def with_topic_details(assigned: DataFrame, catalog: DataFrame, prob_col: str = "probability") -> DataFrame:
    """Adds ``topic`` STRUCT<id, name, keywords, probability>; an unknown topic gets no terms
    and the name ``Topic n``. The catalog is broadcast if its bytes allow (asked once for each
    catalog), else joined by a shuffle."""
    if not hasattr(catalog, "_small"):
        catalog._small = sized_broadcast(catalog, cache=False)[1]
    cat = catalog.select("topic_id", F.col("stored_name").alias("_cat_name"), F.col("keywords").alias("_cat_kw"))
    cat = F.broadcast(cat) if catalog._small else cat
    j = assigned.join(cat, "topic_id", "left")
    return j.withColumn("topic", _topic_column(prob_col)).drop("_cat_name", "_cat_kw")


@once
def _topic_column(prob_col: str) -> Column:
    kws = F.coalesce("_cat_kw", F.array().cast("array<struct<term:string,weight:double>>"))
    name = topic_display_name(F.col("topic_id"), F.col("_cat_name"), F.transform(kws, lambda e: e["term"]))
    return F.struct(F.col("topic_id").alias("id"), name.alias("name"), kws.alias("keywords"), F.col(prob_col).alias("probability"))


def assign_topics_text(
    docs: DataFrame, keys: list[str], text_col: str, terms: DataFrame, max_broadcast_rows: int = 2_000_000
) -> DataFrame:
    """Topic per text from weighted terms: score(topic) = sum over the text's tokens of the
    term weight; best score wins (ties: lower id); probability = best / total.

    Blank text -> (-1, 1.0); text without any topic term -> (-1, 1.0).
    Tokens probe a broadcast (term -> topic, weight) table; two small aggregations follow,
    (text, topic) then text, each pre-aggregated map-side.
    """
    tt, _ = sized_broadcast(terms.select("term", "topic_id", "weight"), max_broadcast_rows)
    # one pass over the input: a blank text contributes no tokens (explode_outer keeps its row)
    ok = F.coalesce(non_blank(F.col(text_col)), F.lit(False))
    base = docs.select(
        *keys,
        F.when(ok, F.lit(0)).otherwise(F.lit(1)).alias("blank"),
        F.when(ok, word_tokens(F.col(text_col))).alias("_toks"),
    )
    toks = base.select(*keys, "blank", F.explode_outer("_toks").alias("term"))
    hits = toks.join(tt, "term", "left")
    per_topic = hits.groupBy(*keys, "blank", "topic_id").agg(F.sum("weight").alias("s"))
    best = per_topic.groupBy(*keys, "blank").agg(
        F.max(F.when(F.col("topic_id").isNotNull(), F.struct(F.round("s", 10).alias("r"), (-F.col("topic_id")).alias("t"), F.col("s").alias("s")))).alias("_bs"),
        F.sum("s").alias("_total"),
    )
    return best.select(
        *keys,
        F.coalesce(-F.col("_bs.t"), F.lit(OUTLIER)).cast("int").alias("topic_id"),
        F.when(F.col("_bs").isNotNull(), F.col("_bs.s") / F.col("_total")).otherwise(F.lit(1.0)).alias("probability"),
        "blank",
    )


def centroid_blocks(centroids: DataFrame, block: int = BLOCK_TOPICS) -> list[DataFrame]:
    """The centroids as one-row frames ``_cs`` ARRAY<STRUCT<topic_id, u>> of about ``block`` unit
    vectors each. Several blocks are gathered in tasks of their own and checkpointed."""
    n = require_rows(centroids, "topic centroids")
    units = centroids.select(F.struct(F.col("topic_id").cast("int").alias("topic_id"), unit(as_double_array(F.col("centroid"))).alias("u")).alias("c"))
    gathered = F.sort_array(F.collect_list("c")).alias("_cs")
    if n <= block:
        return [units.groupBy().agg(gathered)]
    b = F.pmod(F.xxhash64("c.topic_id"), F.lit(-(-n // block)))
    blocks = units.groupBy(b.alias("_b")).agg(gathered).checkpoint()
    return [blocks.where(F.col("_b") == r[0]).select("_cs") for r in blocks.select("_b").sort("_b").collect()]  # one number a block


def assign_topics_vector(
    vecs: DataFrame,
    keys: list[str],
    vec_col: str,
    centroids: DataFrame,
    min_cosine: float = 0.15,
    temperature: float = 0.05,
    block: int = BLOCK_TOPICS,
    pass_blocks: int = PASS_BLOCKS,
) -> DataFrame:
    """Nearest centroid by cosine; below ``min_cosine`` the document is an outlier (-1).

    probability = softmax(cosine / temperature) at the best topic (kept for outliers too).
    Every vector is scored in its own row against broadcast rows of ``block`` centroids: no
    shuffle. Each block's best topic and sum of exponentials are merged into the row's; after
    ``pass_blocks`` blocks the rows are checkpointed, so any number of centroids can be scored
    and a task never holds more than one pass of them. A vector that is null, zero or of another
    length has cosine -1 to all.
    """
    rows = vecs.select(*keys, unit(as_double_array(F.col(vec_col))).alias("_u"))
    blocks = centroid_blocks(centroids, block)

    def far(cos, best):
        return F.exp((cos - best) / F.lit(temperature))

    for k, one in enumerate(blocks):
        if k and k % pass_blocks == 0:
            rows = rows.checkpoint()
        kept = [] if k == 0 else ["_best", "_z"]
        sims = rows.crossJoin(F.broadcast(one)).select(
            *keys,
            "_u",
            *kept,
            F.transform(F.col("_cs"), lambda c: F.struct(F.coalesce(dot(F.col("_u"), c["u"]), F.lit(-1.0)).alias("cos"), c["topic_id"].alias("topic_id"))).alias("_sims"),
        )
        own = F.array_max(F.transform("_sims", lambda s: F.struct(F.round(s["cos"], 10).alias("r"), (-s["topic_id"]).alias("t"), s["cos"].alias("cos"), s["topic_id"].alias("topic_id"))))
        best = sims.select(*keys, "_u", *kept, "_sims", own.alias("_own"))
        z = F.aggregate(F.col("_sims"), F.lit(0.0).cast("double"), lambda acc, s: acc + far(s["cos"], F.col("_own.cos")))
        if k == 0:
            rows = best.select(*keys, "_u", F.col("_own").alias("_best"), z.alias("_z"))
        else:
            both = best.select(*keys, "_u", "_best", "_z", "_own", z.alias("_zo"), F.greatest("_best", "_own").alias("_top"))
            merged = F.col("_z") * far(F.col("_best.cos"), F.col("_top.cos")) + F.col("_zo") * far(F.col("_own.cos"), F.col("_top.cos"))
            rows = both.select(*keys, "_u", F.col("_top").alias("_best"), merged.alias("_z"))
    return rows.select(
        *keys,
        F.when(F.col("_best.cos") >= F.lit(min_cosine), F.col("_best.topic_id")).otherwise(F.lit(OUTLIER)).cast("int").alias("topic_id"),
        (F.lit(1.0) / F.col("_z")).alias("probability"),
        F.col("_best.cos").alias("best_cosine"),
    )


def fit_topics(vecs: DataFrame, vec_col: str, k: int, seed: int = 7, max_iter: int = 20):
    """Topic-model training: k-means on the vectors (Spark ML, distributed Lloyd iterations).

    Returns (centroids (topic_id, centroid), model). K centres of fixed dimension are small, so
    they come back to the driver as the model; the data never does.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    feats = vecs.select("*", array_to_vector(as_double_array(F.col(vec_col))).alias("_features"))
    km = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_features", predictionCol="topic_id")
    model = km.fit(feats)
    spark = vecs.sparkSession
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    cents = spark.createDataFrame(centres, "topic_id int, centroid array<double>")
    return cents, model, feats


def seeded_centroids(vecs: DataFrame, vec_col: str, seed_col: str) -> DataFrame:
    """Guided topics: the centroid of a topic is the mean vector of its seed-labelled rows."""
    per_dim = (
        vecs.select(F.col(seed_col).alias("topic_id"), F.posexplode(vec_col).alias("dim", "x"))
        .groupBy("topic_id", "dim")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
    )
    return per_dim.groupBy("topic_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda e: e["m"]).alias("centroid")
    ).select(F.col("topic_id").cast("int"), "centroid")
