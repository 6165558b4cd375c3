"""The topic model as a stored artefact: fitted, named, written under a version, loaded behind a gate.

A model is three side tables bounded by the number of topics: centroids, weighted terms and names.
``fit_model`` derives terms and names from the documents that the centroids take; ``save_model``
writes the tables below ``<root>/<version>`` and, last of all, ``info``, which makes the version
visible. ``load_model`` reads only versions with ``info`` and refuses one that is empty or not whole, so
a job stops before its first document when its model isn't there.

Edge cases: documents without a text or vector give no terms; a topic without terms has a name all the
same (``Topic n``, or its stored one); ids repeated in either table join as often as they stand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions.topics import topic_display_name
from spindle.operators.topics import assign_topics_vector, topic_catalog, topic_terms

CENTROIDS, TERMS, NAMES, INFO = "centroids", "terms", "names", "info"
PARTS = {
    CENTROIDS: "topic_id int, centroid array<double>",
    TERMS: "topic_id int, term string, weight double, rank int",
    NAMES: "topic_id int, name string",
}
INFO_T = "version string, created timestamp, n_centroids bigint, n_terms bigint, n_names bigint"


class ModelNotReady(RuntimeError):
    """There is no model to start with: none stored, none of that version, or not a whole one."""


@dataclass
class TopicModel:
    centroids: DataFrame
    terms: DataFrame
    names: DataFrame
    version: str | None = None
    min_cosine: float = 0.15
    temperature: float = 0.05

    @property
    def catalog(self) -> DataFrame:
        """(topic_id, stored_name, keywords), made once."""
        if not hasattr(self, "_catalog"):
            self._catalog = topic_catalog(self.terms, self.names)
        return self._catalog

    def assign(self, vecs: DataFrame, keys: list[str], vec_col: str) -> DataFrame:
        """Topic and probability of every vector (``assign_topics_vector``)."""
        return assign_topics_vector(vecs, keys, vec_col, self.centroids, self.min_cosine, self.temperature)


def fit_model(
    centroids: DataFrame, vecs: DataFrame, key: str, vec_col: str, docs: DataFrame, doc_key: str, text_col: str,
    names: DataFrame | None = None, top: int = 10,
) -> TopicModel:
    """Terms and names of the topics that ``centroids`` (of ``fit_topics`` or ``seeded_centroids``) make
    of the documents. ``names`` (topic_id, name) wins over names in the generated form.

    The documents' texts meet (key, topic) rows in one shuffle join on the key; the tokens are
    pre-aggregated by topic and term in every task.
    """
    model = TopicModel(centroids, centroids, centroids)
    found = model.assign(vecs.select(F.col(key).alias("_k"), F.col(vec_col).alias("_v")), ["_k"], "_v").select("_k", "topic_id")
    labelled = docs.select(F.col(doc_key).alias("_k"), F.col(text_col).alias("text")).join(found, "_k").select("topic_id", "text")
    model.terms = topic_terms(labelled, top).cache()
    per_topic = model.terms.groupBy("topic_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda e: e["term"]).alias("_t"))
    topics = centroids.select(F.col("topic_id").cast("int").alias("topic_id")).join(per_topic, "topic_id", "full_outer")
    if names is not None:
        topics = topics.join(names.select("topic_id", F.col("name").alias("_n")), "topic_id", "full_outer")
    else:
        topics = topics.withColumn("_n", F.lit(None).cast("string"))
    terms = F.coalesce("_t", F.array().cast("array<string>"))
    model.names = topics.select("topic_id", topic_display_name(F.col("topic_id"), F.col("_n"), terms).alias("name"))
    return model


def save_model(model: TopicModel, root: str, version: str) -> None:
    """Write the tables, then ``info``. A version is written once; what a lost job left of it without
    ``info`` is replaced."""
    spark = model.centroids.sparkSession
    if any(r["version"] == version for r in versions(spark, root)):
        raise ValueError(f"topic model version {version} exists")
    path = f"{root.rstrip('/')}/{version}"
    counts = {}
    for name, schema in PARTS.items():
        part = getattr(model, name)
        part.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")]).write.mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = spark.read.schema(schema).parquet(f"{path}/{name}").count()
    info = spark.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("created"),
        *[F.lit(n).cast("long").alias(f"n_{name}") for name, n in counts.items()],
    )
    info.coalesce(1).write.mode("overwrite").parquet(f"{path}/{INFO}")


def versions(spark: SparkSession, root: str) -> list:
    """The ``info`` rows of the stored versions, oldest first; one row a version."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/{INFO}/_SUCCESS")
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = [str(s.getPath().getParent()) for s in fs.globStatus(hadoop) or []]
    if not whole:
        return []
    return spark.read.schema(INFO_T).parquet(*whole).orderBy("created", "version").collect()


def load_model(spark: SparkSession, root: str, version: str | None = None) -> TopicModel:
    """The stored model of ``version``, or the newest; ``ModelNotReady`` if it can't be used."""
    stored = [r for r in versions(spark, root) if version in (None, r["version"])]
    if not stored:
        raise ModelNotReady(f"no topic model{f' of version {version}' if version else ''} in {root}")
    info = stored[-1]
    path = f"{root.rstrip('/')}/{info['version']}"
    parts = {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in PARTS.items()}
    for name, part in parts.items():
        n = part.count()
        if n != info[f"n_{name}"] or (n == 0 and name != TERMS):
            raise ModelNotReady(f"topic model {info['version']}: {n} rows of {name}, {info[f'n_{name}']} written")
    return TopicModel(parts[CENTROIDS], parts[TERMS], parts[NAMES], info["version"])
